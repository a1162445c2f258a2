import random

import pytest

WORDS = "the of and thorn ember quiet river stone Über größe naïve été 12 x! don't we'll".split()


def make_rows():
    rng = random.Random(11)
    text = lambda n: " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(n))
    base = text(120)
    edited = base.split()
    edited[7] = "changed"
    passage = text(60)
    rows = [
        (1, base, "en", "src0"), (2, base, "de", "src1"), (3, " ".join(edited), "en", "src0"), (4, None, "en", None), (5, "", "fr", "src2"),
        (6, " \n\t ", "fr", "src2"), (7, "one two", "en", "src0"), (8, "One  TWO", "en", "src1"), (9, "a a a a a " * 30, "en", "src0"),
        (10, text(80) + " " + passage + " " + text(50), "en", "src1"), (11, passage + "\n" + text(90), "en", "src2"),
        (12, 'password = "abcdefgh1234" AKIA' + "Z9" * 8 + " " + "0123456789abcdef" * 3 + " token:short api_key=0a1b2c3d4e5f6a7b8c", "en", "src1"),
        (13, "x 7Fh2kLmNoP9qRsTuVwXyZ y", "en", "src0"), (14, "word " * 30000 + text(40), "en", "src2"), (15, "line one here\nline one here\n\nline one here", "en", None),
        (16, "👍🏽 日本語 テキスト <|endoftext|> 's 'll  \r\n", "en", "src1"), (17, "z" * 5000, "en", "src1"), (17, "z" * 5000, "en", "src1"), (None, "null id text with several words in it", None, None),
    ]
    for i in range(40):  # a group of near copies of one text
        w = base.split()
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"edit{rng.randint(0, 10**6)}"
        rows.append((100 + i, " ".join(w), "en", "src0"))
    for i in range(30):
        toxic = i % 3 == 0
        rows.append((200 + i, text(60) + (" vile scum " if toxic else " ") + text(10), "en", f"src{i % 4}"))
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def folder(spark, rows, tmp_path_factory):
    """A folder of tables like the driver's, with nulls, repeats, ties, long texts and columns whose names clash with results."""
    d = str(tmp_path_factory.mktemp("tables"))
    docs = [(*r, None if r[1] is None else len(r[1]), "mine", 7) for r in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, node string, score int").coalesce(2).write.parquet(f"{d}/documents.parquet")
    labels = [(r[0], 1, int("scum" in r[1])) for r in rows if r[0] and 200 <= r[0] < 230] + [(None, 1, 1), (4, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    pages = [(1, "u", "p" * 200), (2, "u2\r\n", "p" * 200), (3, None, "small"), (4, "u", "small"), (5, "u", None), (0, "u", "p" * 200), (0, "u", "p" * 200), (6, "u", "<é>" * 90)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    return d


@pytest.fixture(scope="session")
def empty_folder(spark, folder, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "labels", "pages"):
        spark.read.parquet(f"{folder}/{t}.parquet").where("false").write.parquet(f"{d}/{t}.parquet")
    return d
