"""N-gram Jaccard self-join with token-combination prefixes.

Tokens are 5-word shingles (64-bit hashes). One packed exchange counts in how many texts each token occurs; tokens of a single
text can match nothing, so only the others return to their texts. In the global order (tokens of one text, then rare ones by
count, then frequent ones) a text of n tokens may miss d = floor(n / 5) of them in any partner, so its prefix is extended until
the classes' worth passes d: a rare token is worth 1 and is indexed alone; frequent tokens are dealt into cells, a cell of c
tokens in the prefix is worth c - 1, and its pairs are indexed. Of two linked texts at least one signature is then shared.
Cells depend on the larger text's size, so a text is indexed for the one or two size classes its partners can set.

Verification is exact. Each signature's texts are compared with one hub first. Where components then leave a signature with more
than one, the nodes of its hub outside the largest component are compared with all nodes of that hub, in tiles, unless sizes or
counts of single-text tokens rule a link out; pairs inside a component need no test and never meet.

Defined results: null, empty or blank texts have no shingle and are linked with nothing; fewer than 5 words are one shingle;
repeated rows and equal sets share a component; rows that share a doc_id are separate texts; a null doc_id is never the smallest
where another row has one;
an empty table gives an empty result; other columns are ignored. Ids are integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_codes, lean, mix, slices, span_hashes, table, text_bytes, words_of, written
from .graph import components
from .packed import SCHEMA, by_block, cuts, exchange, from_planes, home, in_batches, n_reducers, pack_sorted, planes, runs, to_batch, unpack_sorted

WORDS = 5
SLICE = 1 << 20
#: A block ends at so many tokens or documents.
BLOCK_TOKENS, BLOCK_DOCS = 1_000_000, 60_000
#: Names that a reducer sorts at a time.
SORTED = 1 << 20
#: A token of so many texts is frequent. Of so many texts of one block, its rows need not meet in a reducer.
FREQUENT = 64
#: Tiles in which nodes of different components meet.
QUERIES, OTHERS = 512, 4096
_COMMON = 65535
_TOKENS, _HOT, _KNOWN, _DOCS = range(4)
_CODES = byte_codes(15, lower=True)
_SALTS = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], np.uint64)


def shingles(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes and their rows, repeats included."""
    starts, ends, first = words_of(raw, offsets)
    h = span_hashes(raw, starts, ends, _CODES)
    n = np.diff(first)
    row = np.repeat(np.arange(len(n), dtype=np.int32), n)
    out = np.zeros(0, np.uint64), np.zeros(0, np.int32)
    if len(h) >= WORDS:
        m = len(h) - WORDS + 1
        s = sum((h[k : k + m] * _SALTS[k] for k in range(1, WORDS)), h[:m] * _SALTS[0])
        same = row[:m] == row[WORDS - 1 :]
        out = mix(s[same]), row[:m][same]
    few = np.flatnonzero((n > 0) & (n < WORDS))
    short = []
    for i in few.tolist():
        w = h[first[i] : first[i + 1]]
        short.append(int(mix(np.array([np.uint64(len(w)) + (w * _SALTS[: len(w)]).sum(dtype=np.uint64)], np.uint64))[0]))
    return np.concatenate([out[0], np.array(short, np.uint64)]), np.concatenate([out[1], few.astype(np.int32)])


class _Block:
    def __init__(self):
        self.names, self.rows, self.ids, self.null, self.keys, self.sizes, self.of, self.seen = [], [], [], [], [], [], [], {}
        self.tokens = 0

    def add(self, ids: pa.Array, keys: pa.Array, raw: np.ndarray, offsets: np.ndarray) -> None:
        h, row = shingles(raw, offsets)
        order = np.argsort(h, kind="stable")
        h, row = h[order], row[order]
        if len(h):
            fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])
            h, row = h[fresh], row[fresh]
        rows = len(offsets) - 1
        n = np.bincount(row, minlength=rows)
        one, two = np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)  # digests of the sets
        m = mix(h)
        np.add.at(one, row, m)
        np.add.at(two, row, mix(m ^ np.uint64(0x1234567)))
        base, first = len(self.ids), np.empty(rows, np.int64)
        for i, key in enumerate(zip(n.tolist(), one.tolist(), two.tolist(), strict=True)):
            first[i] = self.seen.setdefault(key, base + i)
        own = first == base + np.arange(rows)  # equal sets of a block send their tokens once
        keep = own[row]
        self.names.append(h[keep])
        self.rows.append((row[keep] + base).astype(np.uint16))
        self.tokens += int(keep.sum())
        self.ids += ids.fill_null(0).to_pylist()
        self.null += ids.is_null().to_pylist()
        self.keys += keys.to_pylist()
        self.sizes += n.tolist()
        self.of += first.tolist()

    def sent(self, block: int, reducers: int) -> Iterator[tuple]:
        h, row = np.concatenate(self.names), np.concatenate(self.rows)
        order = np.argsort(h, kind="stable")
        h, row = h[order], row[order]
        starts, lengths = runs(h)
        hot_run = lengths >= FREQUENT
        hot = np.repeat(hot_run, lengths)
        own = home(block, reducers)
        yield own, _DOCS, block, np.array(self.ids + self.keys, np.int64).tobytes() + np.array(self.null, np.uint8).tobytes(), np.array(self.sizes, np.uint32).tobytes(), np.array(self.of, np.uint32).tobytes()
        if hot.any():
            yield own, _KNOWN, block, h[hot].tobytes(), row[hot].tobytes(), np.full(int(hot.sum()), _COMMON, np.uint16).tobytes()
            names = h[starts[hot_run]]
            at = cuts(names, reducers)
            for p in np.flatnonzero(np.diff(at)).tolist():
                yield p, _HOT, block, pack_sorted(names[at[p] : at[p + 1]]), b"", b""
        h, row = h[~hot], row[~hot]
        at = cuts(h, reducers)
        for p in np.flatnonzero(np.diff(at)).tolist():
            a, b = at[p], at[p + 1]
            yield p, _TOKENS, block, pack_sorted(h[a:b]), planes(row[a:b]), b""


def _send(reducers: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, part, made = _Block(), TaskContext.get().partitionId(), 0
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            for i, j in slices(offsets, SLICE):
                for a in range(i, j, BLOCK_DOCS // 4):
                    b = min(j, a + BLOCK_DOCS // 4)
                    block.add(batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    if block.tokens >= BLOCK_TOKENS or len(block.ids) >= BLOCK_DOCS // 2:
                        yield from in_batches(block.sent((part << 24) | made, reducers))
                        block, made = _Block(), made + 1
        if block.ids:
            yield from in_batches(block.sent((part << 24) | made, reducers))

    return run


def _count(reducers: int):
    """Texts of each token; the tokens of more than one text go back to their blocks with that count. A reducer sorts its names by
    ranges of about SORTED, so what it holds is little more than what it was sent."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, rows, blocks, hot = [], [], [], [np.zeros(0, np.uint64)]
        for batch in batches:
            for _, kind, block, a, b, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if kind == _HOT:
                    hot.append(unpack_sorted(a))
                elif kind == _TOKENS:
                    names.append(unpack_sorted(a))
                    rows.append(from_planes(b, np.uint16))
                    blocks.append(block)
                else:
                    yield to_batch([(home(block, reducers), kind, block, a, b, c)])
        if not names:
            return
        everywhere = np.unique(np.concatenate(hot))
        low, high = min(int(x[0]) for x in names), max(int(x[-1]) for x in names)
        parts = -(-sum(map(len, names)) // SORTED)
        edges = np.array([low + (high - low) * k // parts for k in range(1, parts)], np.uint64)
        at = [np.concatenate([[0], np.searchsorted(x, edges), [len(x)]]) for x in names]
        for k in range(parts):
            yield from in_batches(counted(names, rows, blocks, [(x[k], x[k + 1]) for x in at], everywhere))

    def counted(names, rows, blocks, spans, everywhere) -> Iterator[tuple]:
        h = np.concatenate([x[a:b] for x, (a, b) in zip(names, spans, strict=True)])
        order = np.argsort(h, kind="stable")
        starts, lengths = runs(h[order])
        code = np.minimum(lengths, _COMMON - 1).astype(np.uint16)
        code[np.isin(h[order][starts], everywhere)] = _COMMON
        of = np.empty(len(h), np.uint16)
        of[order] = np.repeat(code, lengths)
        begin = 0
        for x, r, block, (a, b) in zip(names, rows, blocks, spans, strict=True):
            code = of[begin : begin + b - a]
            begin += b - a
            many = code > 1
            if many.any():
                yield home(block, reducers), _KNOWN, block, x[a:b][many].tobytes(), r[a:b][many].tobytes(), code[many].tobytes()

    return run


def signatures(names: np.ndarray, code: np.ndarray, n: int) -> list[int]:
    """Signatures of a text of n tokens, of which `names` (with their counts) occur in other texts too."""
    need = n // 5 + 1 - (n - len(names))
    if need <= 0 or n <= 3:
        return []
    order = np.lexsort((names, code))
    names, code = names[order], code[order]
    rare = int(np.searchsorted(code, FREQUENT))
    alone = names[: min(rare, need)]
    out = [mix(alone ^ np.uint64(0x51ED270B))]
    need -= len(alone)
    if need > 0:
        common = names[rare:]
        for size_class in {n.bit_length(), (n + n // 4).bit_length()}:
            cells = max(1, (1 << size_class) // 16)
            cell = (mix(common ^ np.uint64(0x7F4A7C15)) % np.uint64(cells)).astype(np.int64)
            by = np.argsort(cell, kind="stable")
            starts, lengths = runs(cell[by])
            rank = np.empty(len(cell), np.int64)
            rank[by] = np.arange(len(cell)) - np.repeat(starts, lengths)
            length = int(np.searchsorted(np.cumsum(rank > 0), need)) + 1
            by = by[by < length]  # in order of cell, then of the global order
            starts, lengths = runs(cell[by])
            for gap in range(1, int(lengths.max(initial=1))):
                i = np.flatnonzero(cell[by][gap:] == cell[by][:-gap])
                out.append(mix(common[by[i]] * _SALTS[0] + common[by[i + gap]] * _SALTS[1] + np.uint64(size_class)))
    return np.unique(np.concatenate(out)).view(np.int64).tolist()


@lean
def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document: id, row, n, node (equal for equal sets); per own set with signatures: the tokens it may share, and they."""
    for block, rows in by_block(batches):
        ((_, a, b, c),) = [r for r in rows if r[0] == _DOCS]
        sizes, of = np.frombuffer(b, np.uint32), np.frombuffer(c, np.uint32).tolist()
        count = len(sizes)
        ids, keys, null = np.frombuffer(a[: 8 * count], np.int64), np.frombuffer(a[8 * count : 16 * count], np.int64), np.frombuffer(a[16 * count :], np.uint8).astype(bool)
        tokens = [r for r in rows if r[0] == _KNOWN]
        h = np.concatenate([np.frombuffer(r[1], np.uint64) for r in tokens] or [np.zeros(0, np.uint64)])
        row = np.concatenate([np.frombuffer(r[2], np.uint16) for r in tokens] or [np.zeros(0, np.uint16)])
        code = np.concatenate([np.frombuffer(r[3], np.uint16) for r in tokens] or [np.zeros(0, np.uint16)])
        order = np.lexsort((h, row))
        h, row, code = h[order], row[order], code[order]
        at = np.searchsorted(row, np.arange(count + 1))
        nodes, single, shared, sigs = [], [], [], []
        for i, n in enumerate(sizes.tolist()):
            if of[i] != i:
                nodes.append(nodes[of[i]])
                single.append(n)
                shared.append(None)
                sigs.append(None)
                continue
            s = slice(at[i], at[i + 1])
            u = n - (at[i + 1] - at[i])
            same = u == 0 and n > 0
            nodes.append(hashlib.blake2b(h[s].tobytes(), digest_size=16).digest() if same else b"\0" * 8 + ((block << 16) | i).to_bytes(8, "big"))
            found = signatures(h[s], code[s], n)
            single.append(u)
            shared.append(h[s].view(np.int64) if found else None)
            sigs.append(found or None)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64(), mask=null), pa.array(keys, pa.int64()), pa.array(sizes.astype(np.int64)), pa.array(nodes, pa.binary()), pa.array(single, pa.int64()),
                pa.array(shared, pa.list_(pa.int64())), pa.array(sigs, pa.list_(pa.int64())),
            ],
            ["doc_id", "row", "n", "node", "single", "shared", "sigs"],
        )


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) -> (a, b, both): sizes of intersections."""
    s = sets.select("node", "shared")
    p = pairs.join(s.select(F.col("node").alias("a"), F.col("shared").alias("sa")), "a").join(s.select(F.col("node").alias("b"), F.col("shared").alias("sb")), "b")
    return written(p.select(*pairs.columns, F.size(F.array_intersect("sa", "sb")).cast("long").alias("both")))


def _possible(na, nb, ua, ub):
    """Sizes and counts of single-text tokens that leave room for a link."""
    return (5 * F.least(na, nb) >= 4 * F.greatest(na, nb)) & (9 * F.least(na - ua, nb - ub) >= 4 * (na + nb))


def _cross_links(loose: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between components among the nodes of one hub: (u, v), at least one for each node and component that it links to.

    Nodes outside a hub's largest component are the queries, in tiles of QUERIES; they meet all nodes of the hub in tiles of OTHERS.
    The members of the largest component, which may be a third of all rows, never meet each other.
    """
    by_root = loose.groupBy("hub", "root").agg(F.count(F.lit(1)).alias("k"))
    shape = by_root.groupBy("hub").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.max("k").alias("most"), F.sum("k").alias("all")).where("all > most")
    shape = shape.select("hub", "main", F.ceil((F.col("all") - F.col("most")) / QUERIES).cast("int").alias("query_tiles"), F.ceil(F.col("all") / OTHERS).cast("int").alias("other_tiles"))
    n = loose.join(shape, "hub").withColumn("h", F.xxhash64("node", "hub"))
    tile = lambda tiles: F.pmod("h", F.col(tiles)).cast("int")
    along = lambda tiles: F.explode(F.sequence(F.lit(0), F.col(tiles) - 1))
    columns = ["hub", "node", "root", "n", "single", "i", "j", "kind"]
    queries = n.where("root <> main").withColumn("i", tile("query_tiles")).withColumn("j", along("other_tiles")).withColumn("kind", F.lit(0))
    others = n.withColumn("j", tile("other_tiles")).withColumn("i", along("query_tiles")).withColumn("kind", F.lit(1))
    units = queries.select(columns).unionByName(others.select(columns)).join(sets.select("node", "shared"), "node")
    dealt = units.select("hub", "i", "j", "kind", "node", "root", "n", "single", "shared").repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j", "kind", "node")
    return written(dealt.mapInArrow(_tiles, "u binary, v binary"))


class _Tile:
    """Query sets with an inverted index, and which components the links found so far have joined."""

    def __init__(self):
        self.nodes, self.roots, self.n, self.single, self.sets, self.index = [], [], [], [], [], None

    def close(self) -> None:
        tokens = np.concatenate(self.sets)
        rows = np.repeat(np.arange(len(self.sets)), list(map(len, self.sets)))
        order = np.argsort(tokens, kind="stable")
        self.known, at = np.unique(tokens[order], return_index=True)
        self.bounds, self.index = np.append(at, len(tokens)), rows[order]
        self.size, self.alone = np.array(self.n), np.array(self.single)
        self.label: dict[bytes, int] = {}  # of each component
        self.joined: list[int] = []  # label -> a label it was joined with, or itself
        self.of = np.array([self.find(r) for r in self.roots])

    def find(self, root: bytes) -> int:
        at = self.label.setdefault(root, len(self.joined))
        if at == len(self.joined):
            self.joined.append(at)
        while self.joined[at] != at:
            at = self.joined[at]
        return at

    def links(self, node, root, n, single, shared) -> list[tuple[bytes, bytes]]:
        """Links of a node to queries; what the tile's links join already, directly or through others, is not tested again, so a tile
        gives fewer links than it has components."""
        if self.index is None:
            self.close()
        own = self.find(root)
        # bounds by size and by tokens of a single text, before any set is looked at
        low = np.minimum(self.size - self.alone, n - single)
        able = (5 * np.minimum(self.size, n) >= 4 * np.maximum(self.size, n)) & (9 * low >= 4 * (self.size + n)) & (self.of != own)
        if not able.any():
            return []
        at = np.searchsorted(self.known, shared)
        at[at == len(self.known)] = 0
        at = at[self.known[at] == shared]
        first, size = self.bounds[at], self.bounds[at + 1] - self.bounds[at]
        total = int(size.sum())
        flat = np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(total) if total else np.zeros(0, np.int64)
        both = np.bincount(self.index[flat], minlength=len(self.nodes))
        hits = np.flatnonzero(able & (9 * both >= 4 * (self.size + n)))
        labels, place = np.unique(self.of[hits], return_index=True)
        for x in labels.tolist():
            self.joined[x] = own
        self.of[np.isin(self.of, labels)] = own
        return [(self.nodes[hits[k]], node) for k in place.tolist()]


@lean
def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unit, tile = None, _Tile()
    for batch in batches:
        out = []
        columns = [batch.column(i).to_pylist() for i in range(8)]
        values, offsets = np.asarray(batch.column(8).flatten()), np.asarray(batch.column(8).offsets)
        offsets = offsets - offsets[0]
        for k, (hub, i, j, kind, node, root, n, single) in enumerate(zip(*columns, strict=True)):
            if (hub, i, j) != unit:
                unit, tile = (hub, i, j), _Tile()
            shared = values[offsets[k] : offsets[k + 1]]
            if kind == 0:
                tile.nodes.append(node)
                tile.roots.append(root)
                tile.n.append(n)
                tile.single.append(single)
                tile.sets.append(shared.copy())
            elif tile.nodes:
                out += tile.links(node, root, n, single, shared)
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())], ["u", "v"])


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id of every document, and is_first: whether it is the row that stands for its component, the one
    of the smallest id (null last), then of the smallest row number. Texts without words stand for themselves.

    row_col: a column of distinct whole numbers, returned with the result, for callers that decide per row; else rows are numbered here.
    """
    number = F.monotonically_increasing_id() if row_col is None else F.col(row_col).cast("long")
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), number.alias("row"))
    reducers = n_reducers(given)
    sent = given.mapInArrow(_send(reducers), SCHEMA)
    counted = exchange(sent, reducers).mapInArrow(_count(reducers), SCHEMA)
    described = exchange(counted, reducers).mapInArrow(_describe, "doc_id bigint, row bigint, n bigint, node binary, single bigint, shared array<bigint>, sigs array<bigint>")
    described = written(described)
    sets = written(described.where("sigs is not null").dropDuplicates(["node"]))
    marks = written(sets.select(F.explode("sigs").alias("sig"), "node", "n", "single"))

    best = F.min_by(F.struct("node", "n", "single"), F.struct(F.col("single") / F.col("n"), F.col("node")))
    hubs = marks.groupBy("sig").agg(best.alias("hub"), F.count(F.lit(1)).alias("texts")).where("texts > 1").select("sig", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.single").alias("hub_single"))
    # what is joined on a signature or a component is a table by then and joined by sorting, so that AQE splits one that many texts have
    near = written(marks.join(written(hubs).hint("merge"), "sig"))
    first = near.where("hub <> node").where(_possible(F.col("n"), F.col("hub_n"), F.col("single"), F.col("hub_single"))).select(F.col("hub").alias("a"), F.col("node").alias("b"), (F.col("n") + F.col("hub_n")).alias("total")).distinct()
    tested = _verified(first, sets)
    linked = lambda t: t.where("9 * both >= 4 * total").select(F.col("a").alias("u"), F.col("b").alias("v"))
    links = linked(tested)
    roots = components(links)

    placed = near.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    split = placed.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("sig")
    loose = placed.join(written(split).hint("merge"), "sig", "left_semi").where("hub <> node").select("hub", "node", "root", "n", "single").distinct()
    roots = components(links.unionByName(_cross_links(written(loose), sets)))

    member = described.select("doc_id", "row", "n", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    member = written(member.select("doc_id", "row", "n", "root"))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("row").alias("row"))
    least = member.where("n > 0").groupBy("root").agg(F.min(rank).alias("least"))
    number = [F.col("row").alias(row_col)] if row_col is not None else []
    joined = member.where("n > 0").join(written(least).hint("merge"), "root").select(*number, "doc_id", F.col("n").alias("n_shingles"), F.col("least.doc_id").alias("component_id"), (F.col("row") == F.col("least.row")).alias("is_first"))
    return joined.unionByName(member.where("n = 0").select(*number, "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("is_first")))


def op1_ngram_join(spark, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
