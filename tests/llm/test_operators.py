"""Each operator on a fixture of odd rows, against brute force or SQL."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from strandlake.llm import audio, byte_bpe, counting, mixing, ngram_join, rules, secrets, substring_dedup, toxicity, warc
from strandlake.llm.registry import ORACLES, QUERIES

from ..oracle import same

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def key(r):
    return tuple((x is None, x) for x in r)


def table(query, spark, folder, *columns):
    return sorted((tuple(r) for r in query(spark, folder).select(*columns).collect()), key=key)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty_folder, name):
    assert QUERIES[name](spark, empty_folder).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, folder, name):
    if name == "op5_mixing":  # repeated rows make the fixture's ties interchangeable
        same(spark, SF, QUERIES[name], ORACLES[name])
    else:
        same(spark, folder, QUERIES[name], ORACLES[name])
        same(spark, SF, QUERIES[name], ORACLES[name])


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def components(docs):
    sets = []
    for _, t in docs:
        w = WORD.findall(lower(t))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    group = list(range(len(docs)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if 5 * min(len(sets[i]), len(sets[j])) < 4 * max(len(sets[i]), len(sets[j])):
                continue
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                group[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[root(i)].append(d)
    return [(d, len(sets[i]), min(least[root(i)], default=None) if sets[i] else d) for i, (d, _) in enumerate(docs)]


def test_ngram_join(spark, folder, rows):
    got = table(ngram_join.op1_ngram_join, spark, folder, "doc_id", "n_shingles", "component_id")
    assert got == sorted(components([r[:2] for r in rows]), key=key)


def test_ngram_join_large_group(spark, tmp_path):
    """Edits around the threshold, so that components meet across hubs, and frequent tokens index by pairs."""
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(90)]
    docs = []
    for i in range(260):
        w = list(base)
        for k in rng.choice(90, rng.integers(0, 5), replace=False):
            w[k] = f"e{rng.integers(0, 30)}"
        docs.append((i, " ".join(w)))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = table(ngram_join.op1_ngram_join, spark, str(tmp_path), "doc_id", "n_shingles", "component_id")
    assert got == components(docs)


def test_ngram_join_table(spark):
    """A whole test table against brute force over candidate pairs that share a shingle."""
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.op1_ngram_join(spark, "/root/testdata/sf0.01").collect()}
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    assert got == {d: (n, c) for d, n, c in components(docs)}


def test_ngram_join_counts_by_ranges(spark, folder, monkeypatch):
    """The same counts whatever the ranges in which a reducer sorts."""
    rows = []
    for k in range(5):
        names = np.unique(np.random.default_rng(k).integers(0, 4000, 900).astype(np.uint64) << np.uint64(40))
        rows.append((0, ngram_join._TOKENS, k, ngram_join.pack_sorted(names), ngram_join.planes(np.arange(len(names), dtype=np.uint16)), b""))
    found = []
    for most in (1 << 20, 300):
        monkeypatch.setattr(ngram_join, "SORTED", most)
        out = defaultdict(list)
        for batch in ngram_join._count(1)(iter([ngram_join.to_batch(rows)])):
            for _, _, block, a, b, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                out[block] += zip(np.frombuffer(a, np.uint64).tolist(), np.frombuffer(b, np.uint16).tolist(), np.frombuffer(c, np.uint16).tolist(), strict=True)
        found.append({k: sorted(v) for k, v in out.items()})
    count = Counter(int(x) for r in rows for x in ngram_join.unpack_sorted(r[3]))
    assert found[0] == found[1] == {r[2]: [(int(x), i, count[int(x)]) for i, x in enumerate(ngram_join.unpack_sorted(r[3])) if count[int(x)] > 1] for r in rows}


def test_signatures_share_one():
    """Of two linked sets at least one signature is shared, whatever the classes."""
    rng = np.random.default_rng(8)
    for _ in range(300):
        n = int(rng.integers(4, 400))
        names = np.unique(rng.integers(1, 1 << 60, n, dtype=np.uint64))
        code = rng.choice([2, 30, 64, 500, 65535], len(names)).astype(np.uint16)
        x = rng.random(len(names)) > rng.random() * 0.12
        y = rng.random(len(names)) > rng.random() * 0.12
        a, b = int(x.sum()), int(y.sum())
        if 5 * int((x & y).sum()) >= 4 * int((x | y).sum()) and min(a, b) > 3 and (x != y).any():
            assert set(ngram_join.signatures(names[x], code[x], a)) & set(ngram_join.signatures(names[y], code[y], b))


def scalar_pcm(payload):
    """16 kHz samples of a payload by plain loops: expansion by the published formulas, then the point halfway on a cubic."""
    tag = audio.FORMATS[zlib.crc32(payload) % 3]
    if tag == audio.ADPCM:
        x = [v for i in range(0, len(payload), 72) for v in scalar_adpcm(payload[i : i + 72])]
    elif tag == audio.MULAW:
        x = []
        for b in payload:
            b ^= 0xFF
            size = (((b & 15) * 8 + 132) << (b >> 4 & 7)) - 132
            x.append(-size if b & 128 else size)
    else:
        x = []
        for b in payload:
            b ^= 0x55
            e, m = b >> 4 & 7, b & 15
            size = (2 * m + 1) * 8 if e == 0 else ((2 * m + 33) * 8) << (e - 1)
            x.append(size if b & 128 else -size)
    out = []
    for i, v in enumerate(x):
        a, c, d = x[max(i - 1, 0)], x[min(i + 1, len(x) - 1)], x[min(i + 2, len(x) - 1)]
        out += [v, max(-32768, min(32767, (9 * (v + c) - a - d + 8) // 16))]
    return tag, out


def test_audio(spark, folder, rows):
    got = table(audio.op2_audio, spark, folder, "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    expected = []
    for d, t, *_ in rows:
        b = (t or "").encode()
        p = b + b"\xff" * (-len(b) % 576 or (0 if b else 576))
        tag, x = scalar_pcm(p)
        media = audio.wav(p, tag)
        assert media[-len(p) :] == p
        zc = sum((v >= 0) != (w >= 0) for v, w in zip(x, x[1:], strict=False))
        feature = f"tag={tag};n={len(x)};peak={max(map(abs, x))};energy={sum(v * v for v in x)};zc={zc};pcm={zlib.crc32(np.array(x, '<i2').tobytes()):08x}"
        expected.append((d, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature))
    assert got == sorted(expected, key=key)


def test_audio_stored_pcm(spark, folder, rows):
    """The PCM column that is stored holds every sample of every row."""
    sounds = audio.read_media(audio.store_payloads(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "node")))
    assert {"format", "pcm", "node"} <= set(sounds.columns)
    by_sha = {hashlib.sha256(p).hexdigest(): scalar_pcm(p) for p in (audio.padded((r[1] or "").encode()) for r in rows)}
    for r in audio.samples(sounds).collect():
        assert (r.format, np.frombuffer(r.pcm, "<i2").tolist()) == by_sha[r.payload_sha256]


def test_pack_pcm():
    rng = np.random.default_rng(2)
    for x in ([], [5], [1, 2], [-32768, 32767] * 300, range(-700, 700), rng.integers(-32768, 32768, 999)):
        x = np.array(x, np.int16)
        for y in (x, audio.resample(x, 8000, 16000)):
            assert audio.unpack_pcm(audio.pack_pcm(y)).tolist() == y.tolist()


def scalar_adpcm(block):
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for n in (byte & 15, byte >> 4):
            s = int(audio.STEPS[index])
            d = (s >> 3) + (s if n & 4 else 0) + (s >> 1 if n & 2 else 0) + (s >> 2 if n & 1 else 0)
            value = max(-32768, min(32767, value - d if n & 8 else value + d))
            index = max(0, min(88, index + int(audio.INDEX_CHANGE[n])))
            out.append(value)
    return out


def test_audio_codecs(spark):
    blocks = np.random.default_rng(1).integers(0, 256, (40, audio.BLOCK), dtype=np.uint8)
    assert audio.decode_adpcm(blocks).tolist() == [scalar_adpcm(b.tobytes()) for b in blocks]
    mu, a = audio.EXPANDED[audio.MULAW], audio.EXPANDED[audio.ALAW]
    assert (mu[0xFF], mu[0x7F], mu[0x80], mu[0x00]) == (0, 0, 32124, -32124)
    assert (a[0xD5], a[0x55], a[0xAA], a[0x2A]) == (8, -8, 32256, -32256)
    x = np.arange(0, 8000, 10, dtype=np.int16)
    assert np.abs(np.diff(audio.resample(x, 8000, 16000).astype(int))[3:-4] - 5).max() <= 1
    assert len(audio.resample(x, 8000, 11025)) == len(x) * 11025 // 8000
    for tag in audio.FORMATS:
        assert audio.parse_wav(audio.wav(b"\x01" * 144, tag)) == (tag, 8000, audio.BLOCK if tag == audio.ADPCM else 1, b"\x01" * 144)
    df = spark.createDataFrame([(1, bytearray(b"junk")), (2, None)], "doc_id long, media binary")
    assert [(r.format, r.pcm) for r in audio.read_media(df).collect()] == [(None, None)] * 2
    assert [r.feature[:5] for r in audio.pcm_features(audio.read_media(df)).collect()] == ["error"] * 2


def test_counting(spark, folder, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = table(counting.op3_counting, spark, folder, "doc_id", "n_bytes", "n_tokens", "over_limit")
    n = [len(t.encode(r[1] or "", add_special_tokens=False).ids) for r in rows]
    assert got == sorted(((r[0], len((r[1] or "").encode()), k, k > 2048) for r, k in zip(rows, n, strict=True)), key=key)


def test_mixing(spark, folder, rows):
    got = table(mixing.op5_mixing, spark, folder, "doc_id", "size", "source_size", "target", "taken")
    size = Counter()
    for _, t, _, s in rows:
        size[s] += len(WORD.findall(t or ""))
    order = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free = {}, set(order)
    while True:
        rest = sum(size.values()) - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * size[s]]
        if not over:
            break
        target |= {s: 3.0 * size[s] for s in over}
        free -= set(over)
    target |= share
    by_size = {size[s]: s for s in order}
    assert len(by_size) == len(order) and len(got) == len(rows)
    taken = Counter()
    for _, n, source_size, goal, k in got:
        s = by_size[source_size]
        assert abs(goal - target[s]) < 1e-6 and k <= 3 * n
        taken[s] += k
    longest = max(len(WORD.findall(r[1] or "")) for r in rows)
    assert all(abs(taken[s] - target[s]) <= longest for s in order)
    assert got == table(mixing.op5_mixing, spark, folder, "doc_id", "size", "source_size", "target", "taken")


def test_redact_masks_live_spans(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = {r.doc_id: r for r in secrets.redact(docs).collect()}
    assert secrets.redact(docs).columns == docs.columns and docs.count() == secrets.redact(docs).count()
    assert out[13].text == "x <secret> y" and out[13].n_chars == 12
    assert "AKIA" not in out[12].text and "abcdefgh1234" not in out[12].text and "token:short" in out[12].text
    assert out[1].text == docs.where("doc_id = 1").first().text and out[4].text is None


def test_redact_clashing_names(spark):
    """Columns called as the operator's own stay as they are; only the text and its size change."""
    names = ["doc_id", "text", "n_chars", "source", "lang", "owner", "repo", "rid", "kinds", "live", "live_spans", "clean", "doc", "start", "spans"]
    given = [(1, "key AKIA" + "Q7" * 8, 24, "s", "en", *"abcdefghij"), (2, "plain", 5, "s", "en", *"abcdefghij"), (None, None, None, None, None, *[None] * 10)]
    docs = spark.createDataFrame(given, ", ".join(f"{n} {'long' if n in ('doc_id', 'n_chars') else 'string'}" for n in names))
    out = sorted((tuple(r) for r in secrets.redact(docs).collect()), key=key)
    assert secrets.redact(docs).columns == names
    assert out == sorted([(1, "key <secret>", 12, *given[0][3:]), *given[1:]], key=key)


def test_secret_owners_and_repositories(spark):
    """A value is a copied example from the third owner on, and from the fifth repository on, also of one owner."""
    token = lambda i: f"x 7Fh2kLmNoP9qRsTuVwX{i:04d} y"
    places = {0: [("a", "l1")], 1: [("a", "l1"), ("b", "l1")], 2: [("a", "l1"), ("b", "l1"), ("c", "l1")], 3: [("a", f"l{k}") for k in range(4)], 4: [("a", f"l{k}") for k in range(5)], 5: [("a", "l1")] * 9, 6: [(None, "l1"), ("", "l1"), ("a", None)]}
    docs = spark.createDataFrame([(100 * i + k, token(i), *p) for i, ps in places.items() for k, p in enumerate(ps)], "doc_id long, text string, source string, lang string")
    live = {r.doc_id // 100 for r in secrets.scan_secrets(docs).collect() if r.spans}
    assert live == {0, 1, 3, 5}


def test_warc_members(spark, folder):
    archives = warc.write_monolithic(warc.assign_records(spark.read.parquet(f"{folder}/pages.parquet")))
    normal = warc.normalise(archives).collect()
    for a in normal:
        ends = [e.offset + e.length for e in a["index"]]
        assert [e.offset for e in a["index"]] == [0, *ends[:-1]] and ends[-1] == len(a.data)
        assert zlib.decompress(a.data[a["index"][0].offset : ends[0]], 31).startswith(b"WARC/1.1\r\n")
    assert sum(len(a["index"]) for a in normal) == 8
    bodies = warc.read_records(warc.normalise(archives), with_payload=True).where("record_type = 'response'").collect()
    assert bytes(next(r.payload for r in bodies if r.page_id == 6)) == ("<é>" * 90).encode()


def test_warc_odd_inputs(spark):
    """Concatenated members, plain files, padding, cut and damaged streams: whole records stay, and what is lost is said."""
    import gzip

    record = lambda i: warc.record(i, f"u{i}", bytes([65 + i]) * (300 + i), hashlib.sha256(bytes([65 + i]) * (300 + i)).hexdigest(), "response", None)
    four = [record(i) for i in range(4)]
    noise = np.random.default_rng(5).integers(0, 256, 60_000, dtype=np.uint8).tobytes()
    long = warc.record(9, "u9", noise, hashlib.sha256(noise).hexdigest(), "response", None)
    damaged = bytearray(gzip.compress(four[0] + long))
    damaged[-30_000:-29_000] = b"\xff" * 1000
    files = {
        "one": gzip.compress(b"".join(four)),
        "members": gzip.compress(four[0]) + gzip.compress(four[1] + four[2]) + b"\0" * 7 + gzip.compress(four[3]) + b"\0" * 5,
        "plain": b"".join(four),
        "cut": gzip.compress(b"".join([*four, long]))[:-20_000],
        "cut_plain": b"".join(four)[:-9],
        "damaged": bytes(damaged),
        "junk": b"no archive at all",
        "empty": b"",
        "null": None,
    }
    df = spark.createDataFrame([(k, bytearray(v) if v is not None else None) for k, v in files.items()], "archive string, data binary")
    got = {r.archive: r for r in warc.normalise(df).collect()}
    ids = {k: [int(e.record_id.removeprefix("<urn:page:")[:-1]) for e in r["index"]] for k, r in got.items()}
    assert ids == {"one": [0, 1, 2, 3], "members": [0, 1, 2, 3], "plain": [0, 1, 2, 3], "cut": [0, 1, 2, 3], "cut_plain": [0, 1, 2], "damaged": [0], "junk": [], "empty": [], "null": []}
    assert {k for k, r in got.items() if r.status == "whole"} == {"one", "members", "plain", "empty", "null"}
    assert got["cut_plain"].lost_bytes == len(four[3]) - 9 and got["junk"].lost_bytes == 17 and got["cut"].lost_bytes > 0
    assert {r.page_id for r in warc.read_records(warc.normalise(df)).collect()} == {0, 1, 2, 3}


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in toxicity.op7_toxicity(spark, d).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [(labels[i], got[i].predicted) for i in labels if got[i].held_out]
    assert np.mean([a == b for a, b in held]) >= 0.9
    assert not any(b for a, b in held if a == 0)


def scalar_features(text):
    """Distinct features by plain loops: byte codes summed with powers of the base, finished, then pairs and skip-pairs."""
    m = (1 << 64) - 1

    def finish(h):
        for _ in range(2):
            h = ((h ^ (h >> 32)) * 0xD6E8FEB86659FD93) & m
        return h ^ (h >> 32)

    def word(b):
        total, power = 0, 1
        for x in b:
            total, power = (total + int(toxicity._CODES[x]) * power) & m, (power * 0x9E3779B97F4A7C15) & m
        return finish((total + len(b)) & m)

    h = [word(w) for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode())]
    pairs = [finish((a * salt + b) & m) for gap, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)) for a, b in zip(h, h[gap:], strict=False)]
    return {x >> (64 - toxicity.BITS) for x in h + pairs}


def scalar_ftrl(docs, labels):
    """FTRL-proximal as published, one coordinate at a time."""
    n_docs = Counter(f for d in docs for f in d)
    z, n = defaultdict(float), defaultdict(float)

    def weight(f):
        l1 = 0.0 if f is None else toxicity.L1
        if abs(z[f]) <= l1:
            return 0.0
        return -(z[f] - (1 if z[f] > 0 else -1) * l1) / ((toxicity.BETA + n[f] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for d, y in zip(docs, labels, strict=True):
            seen = [*(f for f in d if n_docs[f] >= toxicity.MIN_DOCS), None]
            w = {f: weight(f) for f in seen}
            g = 1 / (1 + np.exp(-max(-35.0, min(35.0, sum(w.values()))))) - y
            for f in seen:
                sigma = ((n[f] + g * g) ** 0.5 - n[f] ** 0.5) / toxicity.ALPHA
                z[f] += g - sigma * w[f]
                n[f] += g * g
    return {f: weight(f) for f in z if f is not None and weight(f)}, weight(None)


def test_toxicity_against_scalar(spark, folder, rows):
    """Model and scores of the fixture, by plain loops in the order of the fit."""
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    y = {r.doc_id: r.toxic for r in labels.collect() if r.doc_id is not None and r.toxic is not None and zlib.crc32(str(r.doc_id).encode()) % 5}
    order = {r.doc_id: r.o for r in labels.where("doc_id is not null").select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("o")).collect()}
    learnt = sorted((order[r[0]], scalar_features(r[1]), y[r[0]]) for r in rows if r[0] in y)
    weights, intercept = scalar_ftrl([f for _, f, _ in learnt], [v for _, _, v in learnt])
    model = toxicity.learn(docs, labels)
    assert weights and model[0].tolist() == sorted(weights)
    assert np.allclose(model[1], [weights[f] for f in sorted(weights)]) and np.isclose(model[2], intercept)
    expected = Counter((r[0], round(1 / (1 + np.exp(-intercept - sum(weights.get(f, 0.0) for f in scalar_features(r[1])))), 9)) for r in rows)
    assert Counter((r.doc_id, round(r.s, 9)) for r in toxicity.score(docs, model, score_col="s").collect()) == expected


def test_toxicity_repeated_ids(spark):
    """However many rows share a labelled id, one text is learnt from, whatever their order."""
    base = [(i, f"vile scum {i % 3}" if i % 2 else f"calm river {i % 3}") for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    more = base + [(1, f"other text {k}") for k in range(50)]
    models = [toxicity.learn(spark.createDataFrame(x, "doc_id long, text string"), labels) for x in (more, more[::-1])]
    assert [m[0].tolist() for m in models][0] == models[1][0].tolist() and np.allclose(models[0][1], models[1][1])


def test_toxicity_without_labels(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.learn(docs, spark.read.parquet(f"{folder}/labels.parquet").where("toxic = 0"))
    assert {r.score for r in toxicity.score(docs, model).collect()} == {0.0}


def test_rules(spark, folder, rows):
    got = table(rules.op8_rules, spark, folder, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    expected = []
    for d, t, *_ in rows:
        t = t or ""
        w, at = WORD.findall(t), defaultdict(list)
        for i in range(len(w) - 2):
            at[tuple(w[i : i + 3])].append(i)
        cover = {p + k for v in at.values() if len(v) > 1 for p in v for k in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        expected.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)))
    assert got == sorted(expected, key=key)


def test_rules_kept(spark, folder, rows):
    """`kept` is the learned list, applied by hand to statistics by hand."""
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    wider = labels.unionByName(spark.createDataFrame([(100 + i, 0, 0) for i in range(40)], labels.schema))
    judged = rules.quality_rules(docs, wider)
    learned = rules.learn_rules(rules.sample_rows(judged, wider))
    assert learned

    def by_hand(t):
        t = t or ""
        w, at = WORD.findall(t), defaultdict(list)
        for i in range(len(w) - 2):
            at[tuple(w[i : i + 3])].append(i)
        cover = {p + k for v in at.values() if len(v) > 1 for p in v for k in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        chars = sum(map(len, w))
        per = lambda a, b: a / max(b, 1)
        x = (len(w), per(chars, len(w)), per(len(re.findall(r"[#*$%&|<>]", t)), len(w)), per(len(lines) - len(set(lines)), len(lines)), per(len(cover), len(w)), per(len(re.findall("[A-Z]", t)), chars), per(t.count("!"), len(w)), per(len(w), len(lines)))
        rejected = any(all(x[f] >= c if above else x[f] < c for f, above, c in rule) for rule in learned)
        return len(w) >= 50 and 100 * len(cover) <= 50 * len(w) and not rejected

    got = Counter((r.doc_id, r.kept) for r in judged.select("doc_id", "kept").collect())
    assert got == Counter((r[0], by_hand(r[1])) for r in rows)
    assert {True, False} == {k for _, k in got}


def test_rules_learned():
    rng = np.random.default_rng(3)
    data = []
    for _ in range(600):
        x = list(rng.random(len(rules.FEATURES)))
        bad = x[2] > 0.9 or (x[5] > 0.8 and x[6] > 0.7)
        data.append((tuple(x), int(not bad)))
    learned = rules.learn_rules(data)

    def kept(x):
        return not any(all(x[f] >= c if above else x[f] < c for f, above, c in rule) for rule in learned)

    assert np.mean([kept(x) == bool(y) for x, y in data]) > 0.95
    assert rules.learn_rules([]) == []


def brute_repeats(docs):
    seen, out = set(), []
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is None, docs[i][0] or 0, i))
    for i in order:
        d, t = docs[i]
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            x = tuple(w[k : k + 20])
            if x in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(x)
        out.append((d, len(w), sum(gone), hashlib.sha256(" ".join(a for a, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    return sorted(out, key=key)


def test_substring_dedup(spark, folder, rows):
    got = table(substring_dedup.op9_substring_dedup, spark, folder, "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == brute_repeats([r[:2] for r in rows])
    assert table(substring_dedup.op9_substring_dedup, spark, SF, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_repeats([(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()])


def test_substring_dedup_random(spark, tmp_path):
    """Few words, so runs, overlaps and partial repeats are frequent."""
    rng = np.random.default_rng(6)
    docs, pool = [], []
    for i in range(120):
        w = []
        while len(w) < rng.integers(0, 200):
            if pool and rng.random() < 0.5:
                p = pool[rng.integers(len(pool))]
                a = int(rng.integers(0, max(1, len(p) - 10)))
                w += p[a : a + int(rng.integers(1, 60))]
            elif rng.random() < 0.3:
                w += [f"r{rng.integers(3)}"] * int(rng.integers(1, 40))
            else:
                w += [f"v{rng.integers(40)}" for _ in range(int(rng.integers(1, 30)))]
        pool.append(w)
        docs.append((int(i), " ".join(w)))
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = table(substring_dedup.op9_substring_dedup, spark, str(tmp_path), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == brute_repeats(docs)


def test_byte_bpe(spark, folder, rows):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    t = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = table(byte_bpe.op10_byte_bpe, spark, folder, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    ids = [t.encode_ordinary(r[1] or "") for r in rows]
    assert got == sorted(((r[0], len(i), sha(" ".join(map(str, i)).encode()), sha((r[1] or "").encode())) for r, i in zip(rows, ids, strict=True)), key=key)
    given = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    c = byte_bpe.codec(path)
    for r in byte_bpe.encode(given.withColumn("again", F.col("text")), path).collect():  # each id's symbol is where its offset says
        data, k, at = (r.again or "").encode(), np.array(r.ids, np.int32), np.array(r.offsets, np.int64)
        assert all(data[a : a + len(c.bytes_of[i])] == c.bytes_of[i] for i, a in zip(r.ids, r.offsets, strict=True))
        for start, end in ((0, 0), (0, 5), (3, 17), (len(data) // 2, len(data)), (len(data), len(data) + 4)):
            assert c.decode_span(k, at, start, end) == data[start:end]
        if len(k) > 1:
            with pytest.raises(ValueError):
                c.decode(k[::-1], at + 1)
    back = byte_bpe.decode(byte_bpe.encode(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang"), path), path)
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((r[0], r[1] or "") for r in rows)


def test_byte_bpe_random_pieces():
    import pyarrow as pa
    import regex

    rng = np.random.default_rng(9)
    alphabet = list("'strevlmdaé1!? \n\t\x85日 ")
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 30))) for _ in range(4000)]
    raw, offsets = byte_bpe.text_bytes(pa.array(texts))
    codec = byte_bpe.codec(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    pattern = regex.compile(public_tokenizers.PATTERN)
    got = list(codec.pieces(raw, offsets))
    assert [b"".join(p).decode() for p, _ in got] == texts
    assert [[x.decode() for x in p] for p, _ in got] == [pattern.findall(t) for t in texts]
    assert [at.tolist() for _, at in got] == [[len(t[: m.start()].encode()) for m in pattern.finditer(t)] for t in texts]
