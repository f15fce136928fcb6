"""Near-duplicate lines: MinHash of character shingles, banding, exact Jaccard check, connected components.

A line is compared as its lower-case words with one blank between them; shingles are its eight-byte stretches in UTF-8. Every task first
joins equal lines and, per band value, keeps one line and links its others to it, so a line that a third of all documents repeat (or
vary) leaves a task once per band. Lines of one band value that these links leave in different components are then compared in blocks
inside the tasks: exactly, unless bitmaps of their stretches show that they cannot be similar.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, key_bits, key_filter, parts_for, prepare, rows_among, staged, text_of
from .graph import components
from .hashing import CHUNK, FACTORS, LOWER, MinHash, common_size, distinct, mixed

WIDTH = 8
# bits of a bit's number in a sketch
SKETCH_BITS = 13
# lower case, every blank but the line feed a space
FOLDED = bytes(0x20 if c in b"\t\x0b\x0c\r" else LOWER[c] for c in range(256))
LINES_PER_PART = 200_000


def compared_lines(text: bytes) -> list[bytes]:
    """The lines as they are compared; blank lines are empty."""
    return [b" ".join(line.split()) if b"  " in line else line.strip() for line in text.translate(FOLDED).split(b"\n")]


def line_key(line: bytes) -> int:
    return xxhash.xxh3_64_intdigest(line) - (1 << 63)


def stretches(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All eight-byte stretches of the lines (a shorter line is one, filled with zeros), as numbers, and where each line's begin."""
    filled = [x.ljust(WIDTH, b"\0") for x in lines]
    sizes = np.array([len(x) for x in filled], np.int64)
    data = b"".join(filled)
    windows = np.empty(len(data) - WIDTH + 1, np.uint64)
    for shift in range(WIDTH):
        every = windows[shift::WIDTH]
        every[:] = np.frombuffer(data, np.uint64, len(every), shift)
    ends = np.cumsum(sizes)
    whole = np.ones(len(windows), bool)
    for back in range(1, WIDTH):
        at = ends - back
        whole[at[at < len(windows)]] = False
    return windows[whole], np.concatenate([[0], np.cumsum(sizes - WIDTH + 1)[:-1]]).astype(np.int64)


def band_values(lines: list[bytes], hashed: MinHash, rows: int) -> np.ndarray:
    """(lines, bands): one number per band of ``rows`` minima."""
    values, starts = stretches(lines)
    minima = hashed.of(mixed(values) >> np.uint64(32), starts).astype(np.uint64)
    out = np.empty((len(lines), minima.shape[1] // rows), np.uint64)
    for band in range(out.shape[1]):
        key = np.full(len(lines), band + 1, np.uint64)
        for k in range(band * rows, (band + 1) * rows):
            key = mixed(key ^ minima[:, k])
        out[:, band] = key
    return out


def starred(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One (key, node) per key, and edges that hold the nodes of a key together: to its first node and to the one before.

    The order of nodes differs from key to key, so that not all bands lean on the same line.
    """
    order = np.lexsort((mixed(nodes.view(np.uint64) ^ keys), keys))
    keys, nodes = keys[order], nodes[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
    head = nodes[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(keys) else nodes
    a = np.concatenate([head[~new], nodes[:-1][~new[1:]] if len(nodes) else nodes])
    b = np.concatenate([nodes[~new], nodes[1:][~new[1:]] if len(nodes) else nodes])
    low, high = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
    order = np.lexsort((high, low))
    low, high = low[order], high[order]
    other = np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])]) if len(low) else np.zeros(0, bool)
    return keys[new], nodes[new], low[other], high[other]


def _occurrences(body: DataFrame, id_kind: str) -> DataFrame:
    """node, doc_id, row_key and pos of every line that is not blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, pos, node = [], [], []
            for i, text in enumerate(batch.column(2).cast(pa.binary()).to_pylist()):
                for p, line in enumerate(compared_lines(text)):
                    if line:
                        source.append(i)
                        pos.append(p)
                        node.append(line_key(line))
            source = pa.array(source, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), batch.column(0).take(source), batch.column(1).take(source), pa.array(pos, pa.int32())],
                                             names=["node", "doc_id", "row_key", "pos"])

    return body.mapInArrow(run, f"node bigint, doc_id {id_kind}, row_key bigint, pos int")


def _candidates(body: DataFrame, bands: int, rows: int, parts: int) -> DataFrame:
    """Pairs (a, b) of lines that share a band value; what tasks send each other are blocks of (band value, line) by part."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, seen = MinHash(bands * rows, seed=31), set()
        keys, nodes, waiting, size = [], [], {}, 0

        def signed():
            if waiting:
                values = band_values(list(waiting.values()), hashed, rows)
                keys.append(values.ravel())
                nodes.append(np.repeat(np.fromiter(waiting, np.int64, len(waiting)), values.shape[1]))
                waiting.clear()

        for batch in batches:
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                for line in compared_lines(text):
                    if line and (key := line_key(line)) not in seen:
                        seen.add(key)
                        waiting[key] = line
                        size += len(line)
                if size > CHUNK:
                    signed()
                    size = 0
        signed()
        if keys:
            key, node, a, b = starred(np.concatenate(keys), np.concatenate(nodes))
            # the part takes the high digits of a value, a block its low 32 bits; what meets by chance fails the exact check
            part = (key >> np.uint64(32)) % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            groups = [g for g in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(g)]
            edges = np.stack([a, b], axis=1)
            blobs = [(int(part[g[0]]), (key[g] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(), node[g].tobytes(), b"") for g in groups]
            blobs += [(int(e[0, 0]) % parts, b"", b"", e.tobytes()) for e in np.array_split(edges, -(-len(edges) // 5000)) if len(e)] if len(edges) else []
            for at in range(0, len(blobs), 64):
                columns = list(zip(*blobs[at : at + 64]))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["part", "keys", "nodes", "edges"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by part: passes on the edges found before and joins the blocks of a part."""
        part, keys, nodes = None, [], []

        def batch_of(a, b):
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        def joined():
            _, _, a, b = starred(np.concatenate(keys), np.concatenate(nodes))
            return batch_of(a, b)

        for batch in batches:
            for row in batch.to_pylist():
                if part is not None and row["part"] != part and keys:
                    yield joined()
                    keys, nodes = [], []
                part = row["part"]
                if row["edges"]:
                    yield batch_of(*np.frombuffer(row["edges"], np.int64).reshape(-1, 2).T)
                else:
                    keys.append(np.frombuffer(row["keys"], np.uint32).astype(np.uint64))
                    nodes.append(np.frombuffer(row["nodes"], np.int64))
        if keys:
            yield joined()

    sent = body.mapInArrow(sign, "part int, keys binary, nodes binary, edges binary").repartition("part").sortWithinPartitions("part")
    return sent.mapInArrow(meet, "a bigint, b bigint").distinct()


def _texts_of(body: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and compared line of the wanted nodes."""
    wanted = nodes.select("node")
    bits = key_bits(wanted, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            found: dict[int, bytes] = {}
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                for line in compared_lines(text):
                    if line and (key := line_key(line)) not in seen and key not in found:
                        found[key] = line
            keys = np.fromiter(found, np.int64, len(found))
            among = bits.among(keys)
            seen.update(keys[among].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(list(found.values()), pa.binary())], names=["node", "line"]).filter(pa.array(among))

    return body.mapInArrow(run, "node bigint, line binary").join(wanted, "node", "left_semi").dropDuplicates(["node"])


def similar(pairs: DataFrame, lines: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose stretches have a Jaccard similarity of at least ``percent`` in a hundred."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # every line of the batch once, all together
            at: dict[bytes, int] = {}
            pairs = [(at.setdefault(x, len(at)), at.setdefault(y, len(at))) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            values, starts = stretches(list(at)) if at else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            ends = [*starts[1:].tolist(), len(values)]
            sets = [distinct(values[i:j]) for i, j in zip(starts.tolist(), ends)]
            keep = []
            for x, y in pairs:
                x, y = sets[x], sets[y]
                both = common_size(x, y) if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) else 0
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one, other = lines.select(F.col("node").alias("a"), F.col("line").alias("x")), lines.select(F.col("node").alias("b"), F.col("line").alias("y"))
    return pairs.join(one, "a").join(other, "b").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def sketches(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per line a bitmap of the stretches it holds, how many bits are set and how many stretches there are (repeated ones too)."""
    values, starts = stretches(lines)
    sizes = np.diff(starts, append=len(values))
    has = np.zeros(len(lines) << SKETCH_BITS, bool)
    has[((values * FACTORS[0]) >> np.uint64(64 - SKETCH_BITS)).view(np.int64) + np.repeat(np.arange(len(lines)) << SKETCH_BITS, sizes)] = True
    bits = np.packbits(has).view(np.uint64).reshape(len(lines), -1)
    return bits, np.bitwise_count(bits).sum(axis=1, dtype=np.int64), sizes


def may_be_similar(lines: list[bytes], root: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a line of ``left`` and one of ``right`` (positions) of different roots, without those that are surely not similar.

    Every bit that only one line of a pair has set stands for a stretch at least that the other does not hold.
    """
    bits, filled, sizes = sketches(lines)
    once = np.array_equal(left, right)
    step, found = max(1, (1 << 17) // (len(right) * bits.shape[1])), []
    theirs = bits[right]
    for at in range(0, len(left), step):
        rows = left[at : at + step]
        both = np.bitwise_count(bits[rows, None] & theirs).sum(axis=2, dtype=np.int64)
        own, other = filled[rows, None] - both, filled[right] - both
        most = np.minimum(sizes[rows, None] - own, sizes[right] - other)
        may = (100 * most >= percent * (most + own + other)) & (root[rows, None] != root[right])
        if once:
            may &= np.arange(at, at + len(rows))[:, None] < np.arange(len(right))
        i, j = np.nonzero(may)
        found.append((rows[i], right[j]))
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def links_among(lines: list[bytes], root: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Links between lines of ``left`` and of ``right`` (positions) that join all their components that a similar pair joins: every pair
    of different components that a sketch does not rule out is compared exactly."""
    one, other = may_be_similar(lines, root, left, right, percent)
    if not len(one):
        return
    used = np.unique(np.concatenate([one, other]))
    one, other = np.searchsorted(used, one), np.searchsorted(used, other)
    values, starts = stretches([lines[i] for i in used])
    sets = [distinct(x) for x in np.split(values, starts[1:])]
    size = np.array([len(x) for x in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    begin = np.concatenate([[0], np.cumsum(size)])
    has, root = np.zeros(int(ids.max()) + 1, np.uint8), root[used]
    cuts = np.flatnonzero(np.diff(one)) + 1
    for i, met in zip(one[np.concatenate([[0], cuts])], np.split(other, cuts)):
        met = met[root[met] != root[i]]
        if not len(met):
            continue
        has[ids[begin[i] : begin[i + 1]]] = 1
        theirs = np.concatenate([ids[begin[j] : begin[j + 1]] for j in met])
        both = np.add.reduceat(has[theirs], np.concatenate([[0], np.cumsum(size[met])[:-1]]), dtype=np.int64)
        has[ids[begin[i] : begin[i + 1]]] = 0
        for j in met[100 * both >= percent * (size[i] + size[met] - both)]:
            if root[j] != root[i]:
                root[root == root[j]] = root[i]
                yield int(used[i]), int(used[j])


def crowded_links(lines: DataFrame, label: DataFrame, percent: int, bands: int, rows: int, block: int = 2048) -> DataFrame:
    """Links (a, b) between components of ``label`` (node, root) that have similar lines with a common band value.

    The lines of a band value are compared in blocks of about ``block`` inside the tasks; what leaves them is at most one link per line.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = MinHash(bands * rows, seed=31)
        for batch in batches:
            if batch.num_rows:
                keys = band_values(batch.column(1).to_pylist(), hashed, rows)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), keys.shape[1]))], names=["key", "node"])

    signs = lines.select("node", "line").mapInArrow(sign, "key bigint, node bigint").join(label, "node", "left")
    signs = staged(signs.select("key", "node", F.coalesce("root", "node").alias("root")), "line-bands")
    # two lines have met already
    full = signs.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("n > 2 AND low <> high")
    full = staged(full.select("key", "n"), "line-crowded")
    blocks = F.ceil(F.col("n") / block)
    members = rows_among(signs, full, "key").join(full, "key").join(lines, "node")
    members = members.withColumn("own", F.pmod(F.xxhash64("node", F.lit(3)), blocks).cast("int")).withColumn("met", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))))
    members = members.select("key", F.least("own", "met").alias("low"), F.greatest("own", "met").alias("high"), "own", "node", "root", "line")
    members = members.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for (_, low, high), group in groupby((r for batch in batches for r in batch.to_pylist()), key=lambda r: (r["key"], r["low"], r["high"])):
            group = list(group)
            own, root = np.array([r["own"] for r in group]), np.array([r["root"] for r in group])
            left, right = np.flatnonzero(own == low), np.flatnonzero(own == high)
            if len(left) and len(right):
                out += [(group[i]["node"], group[j]["node"]) for i, j in links_among([r["line"] for r in group], root, left, right, percent)]
        a, b = zip(*out) if out else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    found = staged(members.mapInArrow(run, "a bigint, b bigint").distinct(), "line-crowded-links")
    discard(signs, full)
    return found


def dedup_lines(docs: DataFrame, percent: int = 80, bands: int = 10, rows: int = 3, parts: int | None = None, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """Every input row with its columns as the struct ``document`` and n_lines, n_kept and the deduplicated ``text``.

    Lines end at a line feed. Of each component of similar lines the occurrence with the smallest id (null last), then the smallest row
    hash and position, stays; all others go with their line feed. Blank lines are never compared and stay where another line stays.
    Rows that agree in id and text count as one document and get the same result. Null texts count as empty; an empty table gives no
    rows. A pair at the threshold has a common band value with probability 1 - (1 - 0.8^rows)^bands (0.9992 with the defaults), and every
    pair of different components that has one is checked exactly or surely dissimilar, however crowded the value is; lines are told apart by 64-bit keys.
    """
    prepare(docs.sparkSession)
    spark = docs.sparkSession
    text = text_of(text_col)
    body = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), text).alias("row_key"), text.alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    lined = staged(_occurrences(body, kind), "line-occurrences")
    # a part's band values are held together in a task: their number follows the lines
    parts = parts or max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")), parts_for(lined.count(), LINES_PER_PART))
    edges = staged(_candidates(body, bands, rows, parts), "line-edges")
    nodes = staged(edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct(), "line-nodes")
    lines = staged(_texts_of(body, nodes), "line-texts")
    links = staged(similar(edges, lines, percent), "line-links")
    discard(edges, nodes)
    first = staged(components(links), "line-first-roots")
    more = crowded_links(lines, first, percent, bands, rows)
    # links between the first components join their roots
    roots = staged(components(first.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more)), "line-roots")
    discard(lines, first, more)

    occurrence = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("row_key"), F.col("pos"))
    classes = lined.groupBy("node").agg(F.min(occurrence).alias("first"), F.max(occurrence).alias("last"))
    linked = key_filter(roots.select("node").union(roots.select(F.col("root").alias("node"))), "node")
    # lines that stand once and are like no other go no further
    classes = staged(classes.where((F.col("first") != F.col("last")) | linked("node")), "line-classes")
    grouped = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    heads = grouped.groupBy("root").agg(F.min("first").alias("keep"), F.max("last").alias("last")).where("keep <> last")
    repeated = staged(grouped.join(heads.select("root", "keep"), "root").select("node", "keep"), "line-repeated")
    here = [F.col("row_key").eqNullSafe(F.col("keep.row_key")), F.col("doc_id").eqNullSafe(F.col("keep.doc_id")), F.col("pos") == F.col("keep.pos")]
    again = key_filter(repeated, "node")
    gone = lined.where(again("node")).join(repeated, "node").where(~(here[0] & here[1] & here[2]))
    gone = staged(gone.groupBy("row_key").agg(F.sort_array(F.collect_set("pos")).alias("gone")), "lines-gone")
    discard(lined, links, roots, classes, repeated)

    # the text travels once: in the struct
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"), F.xxhash64(F.col(id_col), text).alias("row_key"))
    joined = whole.join(gone, "row_key", "left").withColumn("text", text_of(F.col("document").getField(text_col)))
    kept = F.filter(F.split("text", "\n", -1), lambda line, i: ~F.array_contains("gone", i))
    # a match runs from a line's first visible character to its end
    result = joined.withColumns({"n_lines": F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D][^\n]*")).cast("int"),
                                 "n_gone": F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone"))})
    return result.select("document", "n_lines", (F.col("n_lines") - F.col("n_gone")).alias("n_kept"),
                         F.when(F.col("gone").isNull(), F.col("text")).when(F.col("n_lines") == F.col("n_gone"), "").otherwise(F.array_join(kept, "\n")).alias("text"))


def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """All documents: lines before and after, and the text that is left."""
    return dedup_lines(spark.read.parquet(f"{folder}/documents.parquet")).select(F.col("document.doc_id").alias("doc_id"), "n_lines", "n_kept", "text")
