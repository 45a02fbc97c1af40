"""Near-duplicate texts: tiled exact comparison of bitmaps, then exact similarity, then groups.

Every distinct text is the set of its word runs, hashed to 64 bits, and a bitmap with one bit per run's hash. Two bitmaps
differ in no more bits than their sets differ in runs, so bitmaps that differ in more bits than a similarity allows prove
that two texts are not alike; nothing that is alike is lost. Bitmaps are sorted by population count and cut into blocks;
pairs of blocks, and of tiles within them, whose population counts or sizes differ beyond the radius are skipped, the rest
are compared by exclusive-or and bit counts. A task holds a few blocks and lets others stream past them, and keeps no
pairs, only which texts hang together. What hangs together is then verified on the sets themselves, pair by pair.

Comparing all blocks with all others grows with the square of the number of distinct texts: that is the method's price.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.components import components, merge_labels
from docketry.session import drop_materialized, materialize

_WORD = re.compile(r"[^\W_]+")
#: Rows and columns compared at once, so that the work fits a core's cache.
TILE_ROWS, TILE_COLS = 128, 1024
#: Levels of population count by which blocks are laid out.
LEVELS = 128
#: Characters of text whose words are numbered together.
BATCH_CHARS = 2_000_000
#: Members of a group that meet in one task when pairs are listed.
PAIR_ROWS = 1000


@dataclass(frozen=True)
class Likeness:
    """run: words in a run; share: least shared part of the runs found in either text, as numerator and denominator."""

    run: int = 5
    share: tuple[int, int] = (4, 5)
    #: Texts in a block, and bytes of their bitmaps, at most.
    block_rows: int = 16384
    block_bytes: int = 4 << 20
    #: Blocks that a task holds, and that stream past it, at most.
    held: int = 8
    streamed: int = 32
    #: Bytes of sets that are verified together; a task has at most two such chunks.
    chunk_bytes: int = 8 << 20

    def __post_init__(self):
        if 2 * self.share[0] < self.share[1]:
            raise ValueError("a share under one half would need more than neighbouring size classes")

    def radius(self, total: np.ndarray | int):
        """The largest difference of two sets that are alike, of so many elements together, as a fraction."""
        n, d = self.share
        return (d - n) * total, d + n

    def far(self, a: dict, b: dict) -> bool:
        """Whether no text of block a can be like one of block b, by sizes, and within a size class by population counts."""
        n, d = self.share
        if max(a["n_min"], b["n_min"]) * n > min(a["n_max"], b["n_max"]) * d:
            return True
        most, scale = self.radius(a["n_max"] + b["n_max"])
        return abs(a["cls"] - b["cls"]) > 1 or (a["cls"] == b["cls"] and max(a["low"] - b["high"], b["low"] - a["high"]) * scale > most)


def _mixed(h: np.ndarray, run: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of words with the hashes h."""
    if len(h) < run:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - run + 1].copy()
    with np.errstate(over="ignore"):
        for i in range(1, run):
            out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[i : len(h) - run + 1 + i]
        out = (out ^ (out >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return np.unique(out ^ (out >> np.uint64(31)))


def run_hashes(texts: list[str], run: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of the runs of words of every text; words are the lower-cased runs of letters and
    digits, and each distinct word of some texts is hashed once."""
    at = 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and (end == at or chars < BATCH_CHARS):
            chars += len(texts[end])
            end += 1
        words, lens = [], []
        for t in texts[at:end]:
            found = _WORD.findall(t.lower())
            lens.append(len(found))
            words += found
        coded = pa.array(words, pa.large_string()).dictionary_encode()
        distinct = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
        h = distinct[coded.indices.to_numpy(zero_copy_only=False)] if words else np.zeros(0, np.uint64)
        start = 0
        for n in lens:
            yield _mixed(h[start : start + n], run)
            start += n
        at = end


def text_key(h: np.ndarray, text: str) -> bytes:
    """One value for all texts with the same runs, which are alike whatever else they say; one without runs equals only
    itself."""
    return xxhash.xxh3_128_digest(h.tobytes() if len(h) else "=" + text)


def size_class(n: int) -> int:
    return max(int(n).bit_length() - 1, 5)


def bits_of(size_class: int) -> int:
    """Bits of the bitmaps that texts of a class are compared with among themselves: at least twice their runs."""
    return 1 << (size_class + 2)


def bitmap(hashes: np.ndarray, bits: int) -> np.ndarray:
    """One bit per hash, as 64-bit words; the bitmap of half the width is the two halves' or."""
    out = np.zeros(bits, bool)
    out[(hashes & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").view(np.uint64)


def _prints(like: Likeness):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {"id": [], "text_key": [], "n": [], "cls": [], "level": [], "bits": []}
            kept = [(i, t) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t is not None and i is not None]
            for (i, t), h in zip(kept, run_hashes([t for _, t in kept], like.run), strict=True):
                rows["id"].append(i)
                rows["text_key"].append(text_key(h, t))
                rows["n"].append(len(h))
                c = size_class(len(h))
                wide = bitmap(h, 2 * bits_of(c))
                rows["cls"].append(c)
                rows["level"].append(int(np.bitwise_count(wide).sum()) * LEVELS // (2 * bits_of(c)))
                rows["bits"].append(wide.tobytes())
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("id", pa.string()), ("text_key", pa.binary()), ("n", pa.int32()), ("cls", pa.int32()), ("level", pa.int32()), ("bits", pa.binary())]))

    return run


def _laid_out(texts: DataFrame, like: Likeness) -> DataFrame:
    """Adds block: texts of one size class with neighbouring population counts, as many as fit a block. A small table has
    smaller blocks, so that they give every core work."""
    # LEVELS rows per size class at most, of which there are as many as doublings of the longest text
    counts = sorted((r["cls"], r["level"], r["n"]) for r in texts.groupBy("cls", "level").agg(F.count("*").alias("n")).collect())
    share = sum(n for _, _, n in counts) // (2 * texts.sparkSession.sparkContext.defaultParallelism)
    rows, block, room, last = [], -1, 0, None
    for cls, level, n in counts:
        most = max(64, min(like.block_rows, like.block_bytes // (bits_of(cls) // 4), max(1024, share)))
        split = -(-n // most)
        if split > 1:  # a level that fills blocks of its own
            rows.append((cls, level, block + 1, split))
            block, room = block + split, 0
        else:
            if cls != last or n > room:
                block, room = block + 1, most
            rows.append((cls, level, block, 1))
            room -= n
        last = cls
    layout = texts.sparkSession.createDataFrame(rows, "cls int, level int, first int, split int")
    out = texts.join(F.broadcast(layout), ["cls", "level"])
    return out.withColumn("block", F.col("first") + F.pmod(F.xxhash64("text_key"), F.col("split")).cast("int")).drop("first", "split", "level")


_BLOCK = "block int, cls int, n_min int, n_max int, low int, high int, ids array<string>, text_keys array<binary>, ns binary, wide binary, narrow binary"
_META = ("block", "cls", "n_min", "n_max", "low", "high")
#: Rows of a block are numbered from block << ROW_BITS.
ROW_BITS = 20


def _packed(rows: pa.Table) -> pa.Table:
    """One row per block, its texts sorted by population count, with their bitmaps in full and in half width."""
    cls = rows.column("cls")[0].as_py()
    bits = np.frombuffer(b"".join(rows.column("bits").to_pylist()), np.uint64).reshape(-1, 2 * bits_of(cls) // 64)
    pops = np.bitwise_count(bits).sum(axis=1)
    keys = rows.column("text_key").to_pylist()
    order = np.lexsort((np.array(keys, object), pops))
    bits, half = bits[order], bits.shape[1] // 2
    n = rows.column("n").to_numpy().astype(np.int32)[order]
    of = lambda c: rows.column(c).combine_chunks().take(pa.array(order))
    one = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
    numbers = [rows.column("block")[0].as_py(), cls, int(n.min()), int(n.max()), int(pops.min()), int(pops.max())]
    binaries = [n.tobytes(), bits.tobytes(), (bits[:, :half] | bits[:, half:]).tobytes()]
    return pa.Table.from_arrays([*[pa.array([x], pa.int32()) for x in numbers], one(of("id")), one(of("text_key")), *[pa.array([x], pa.binary()) for x in binaries]], [*_META, "ids", "text_keys", "ns", "wide", "narrow"])


def near_pairs(na: np.ndarray, a: np.ndarray, nb: np.ndarray, b: np.ndarray, like: Likeness, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a and of b whose bitmaps differ by no more than likeness allows, tile by tile.

    a and b are words x rows, rows sorted by population count; same: the two are one block, pairs are given once. Sets of
    one size differ by two elements at least, others by the difference of their sizes."""
    pa_, pb_ = np.bitwise_count(a).sum(axis=0).astype(np.int32), np.bitwise_count(b).sum(axis=0).astype(np.int32)
    n, d = like.share
    for i in range(0, a.shape[1], TILE_ROWS):
        ra = slice(i, i + TILE_ROWS)
        for j in range(i - i % TILE_COLS if same else 0, b.shape[1], TILE_COLS):
            rb = slice(j, j + TILE_COLS)
            most, scale = like.radius(int(na[ra].max()) + int(nb[rb].max()))
            if max(pb_[rb][0] - pa_[ra][-1], pa_[ra][0] - pb_[rb][-1]) * scale > most or max(na[ra].min(), nb[rb].min()) * n > min(na[ra].max(), nb[rb].max()) * d:
                continue
            far = np.zeros((pa_[ra].size, pb_[rb].size), np.uint16 if a.shape[0] < 1000 else np.uint32)
            for w in range(a.shape[0]):
                far += np.bitwise_count(a[w, ra, None] ^ b[w, None, rb])
                if 2 * w >= a.shape[0] and far.min() > most // scale:
                    break  # no pair of the tile can come back under the limit
            if far.min() > most // scale:
                continue
            limit, scale = like.radius(na[ra, None] + nb[None, rb])
            apart = np.abs(na[ra, None] - nb[None, rb])
            i_, j_ = np.nonzero((far <= limit // scale) & (np.where(apart, apart, 2) <= limit // scale))
            keep = (j_ + j > i_ + i) if same else slice(None)
            yield i_[keep] + i, j_[keep] + j


class _Held:
    """A block in a task: its rows' numbers, sizes and bitmaps, sorted by population count in either width."""

    def __init__(self, row: dict, full: bool):
        self.meta = {k: row[k] for k in _META}
        self.ns = np.frombuffer(row["ns"], np.int32)
        self.first = row["block"] << ROW_BITS
        self.wide = np.frombuffer(row["bits"], np.uint64).reshape(len(self.ns), -1)
        self.sides: dict[bool, tuple] = {}
        self.full = full

    def side(self, narrow: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if narrow not in self.sides:
            bits, half = self.wide, self.wide.shape[1] // 2
            if narrow and self.full:
                bits = bits[:, :half] | bits[:, half:]
            order = np.argsort(np.bitwise_count(bits).sum(axis=1), kind="stable")
            self.sides[narrow] = (self.ns[order], np.ascontiguousarray(bits[order].T), order)
        return self.sides[narrow]


def _compare(like: Likeness):
    """Rows of a task, the blocks it holds before those that stream past: which texts hang together, as links (a, b)."""

    def ended(held: list[_Held], label: np.ndarray) -> Iterator[pa.RecordBatch]:
        if held:
            number = np.concatenate([h.first + np.arange(len(h.ns), dtype=np.int64) for h in held])
            at = np.flatnonzero(label != np.arange(len(label)))
            yield pa.RecordBatch.from_arrays([pa.array(number[at]), pa.array(number[label[at]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, label, offsets = None, [], np.zeros(0, np.int64), []
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                if row["task"] != task:
                    yield from ended(held, label)
                    task, held, label, offsets = row["task"], [], np.zeros(0, np.int64), []
                block = _Held(row, not row["streams"])
                if not row["streams"]:
                    offsets.append(len(label))
                    label = np.concatenate([label, len(label) + np.arange(len(block.ns))])
                    held.append(block)
                    continue
                own = len(label)
                label = np.concatenate([label, own + np.arange(len(block.ns))])
                nb, b, order_b = block.side(True)
                for h, offset in zip(held, offsets, strict=True):
                    if h.meta["block"] > block.meta["block"] or like.far(h.meta, block.meta):
                        continue
                    # the next size class has bitmaps of twice the width
                    na, a, order_a = h.side(h.meta["cls"] == block.meta["cls"])
                    same = h.meta["block"] == block.meta["block"]
                    for i, j in near_pairs(na, a, nb, b, like, same):
                        merge_labels(label, offset + order_a[i], (offset if same else own) + order_b[j])
                found = label[own:]
                out = np.flatnonzero(found != own + np.arange(len(found)))
                number = np.concatenate([*[h.first + np.arange(len(h.ns), dtype=np.int64) for h in held], block.first + np.arange(len(found), dtype=np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array(number[own + out]), pa.array(number[found[out]])], ["a", "b"])
                # texts that hang together by way of the streamed block alone hang together still
                label = label[:own].copy()
        yield from ended(held, label)

    return run


def _tasks(meta: list[dict], like: Likeness, cores: int) -> pd.DataFrame:
    """(task, block, streams): every pair of blocks that may hold texts alike meets in one task."""
    of_class: dict[int, list[dict]] = {}
    for m in meta:
        of_class.setdefault(m["cls"], []).append(m)
    partners = {m["block"]: [b["block"] for c in (m["cls"], m["cls"] + 1) for b in of_class.get(c, ()) if b["block"] >= m["block"] and not like.far(m, b)] for m in meta}
    per_task = max(1, min(like.held * like.streamed, sum(map(len, partners.values())) // (4 * cores)))
    held = max(1, min(like.held, int((per_task / 4) ** 0.5)))
    streamed = max(1, min(like.streamed, -(-per_task // held)))
    rows, task = [], 0
    for i in range(0, len(meta), held):
        own = [m["block"] for m in meta[i : i + held]]
        wanted = sorted(set().union(*[partners[b] for b in own]))
        for j in range(0, len(wanted), streamed):
            rows += [(task, b, False) for b in own] + [(task, b, True) for b in wanted[j : j + streamed]]
            task += 1
    return pd.DataFrame(rows, columns=["task", "block", "streams"])


def _candidates(blocks: DataFrame, like: Likeness) -> DataFrame:
    """(a, b): numbers of texts that hang together by their bitmaps. All texts that are alike do."""
    spark = blocks.sparkSession
    meta = [r.asDict() for r in blocks.select(*_META).orderBy("block").collect()]  # six numbers per block of texts
    plan = _tasks(meta, like, spark.sparkContext.defaultParallelism)
    if plan.empty:
        return spark.createDataFrame([], "a bigint, b bigint")
    where = spark.createDataFrame(plan, "task int, block int, streams boolean")
    held = where.filter("not streams").join(blocks.select(*_META, "ns", F.col("wide").alias("bits")), "block")
    streamed = where.filter("streams").join(blocks.select(*_META, "ns", F.col("narrow").alias("bits")), "block")
    both = held.unionByName(streamed).repartitionById(int(plan["task"].max()) + 1, "task").sortWithinPartitions("task", "streams")
    return both.mapInArrow(_compare(like), "a bigint, b bigint")


def _with_grams(like: Likeness):
    """Texts of candidates to their sets; a row whose text is another one under the same id is dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            keys, keep, grams = batch.column("text_key").to_pylist(), [], []
            for k, t, h in zip(keys, texts, run_hashes(texts, like.run), strict=True):
                keep.append(text_key(h, t) == k)
                grams.append(h.tobytes() if keep[-1] else None)
            columns = [batch.column(c) for c in ("node", "part", "x", "chunk", "chunks")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(grams, pa.binary())], ["node", "part", "x", "chunk", "chunks", "grams"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verified(like: Likeness):
    num, den = like.share

    def run(rows: pa.Table) -> pa.Table:
        """(a, b, n): texts that are linked, directly or through others, and with b null the number of links of a text, among
        the texts of a chunk or between those of two."""
        x, y = rows.column("x")[0].as_py(), rows.column("y")[0].as_py()
        part, chunk, node = (rows.column(c).to_numpy() for c in ("part", "chunk", "node"))
        _, first = np.unique(node, return_index=True)  # exact repeats of a row
        order = first[np.argsort(part[first], kind="stable")]
        grams = rows.column("grams")
        part, chunk, node = part[order], chunk[order], node[order]
        label, links = np.arange(len(node)), np.zeros(len(node), np.int64)
        starts = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]])
        for low, high in zip(starts[:-1], starts[1:], strict=True):
            sets = [np.frombuffer(grams[int(order[k])].as_buffer(), np.uint64) for k in range(low, high)]
            n = np.array([len(g) for g in sets], np.int64)
            _, code = np.unique(np.concatenate(sets), return_inverse=True)
            owner = np.repeat(np.arange(high - low), n)
            by_code = np.argsort(code, kind="stable")
            holders, bounds = owner[by_code], np.concatenate([[0], np.cumsum(np.bincount(code))])
            at = np.concatenate([[0], np.cumsum(n)])
            for i in range(high - low) if x == y else np.flatnonzero(chunk[low:high] == x):
                own = code[at[i] : at[i + 1]]
                size = bounds[own + 1] - bounds[own]
                ends = np.cumsum(size)
                # the holders of each of its runs, one list after another
                where = np.arange(int(ends[-1])) + np.repeat(bounds[own] - (ends - size), size)
                shared = np.bincount(holders[where], minlength=high - low)
                near = np.flatnonzero(shared * den >= num * (n[i] + n - shared))
                near = near[near > i] if x == y else near[chunk[low + near] == y]
                links[low + i] += len(near)
                links[low + near] += 1
                merge_labels(label, np.full(len(near), low + i), low + near)
        at, some = np.flatnonzero(label != np.arange(len(label))), np.flatnonzero(links)
        return pa.table({"a": pa.array(np.concatenate([node[at], node[some]]), pa.int64()), "b": pa.concat_arrays([pa.array(node[label[at]], pa.int64()), pa.nulls(len(some), pa.int64())]), "n": pa.array(np.concatenate([np.zeros(len(at), np.int64), links[some]]), pa.int64())})

    return run


@dataclass(frozen=True)
class Found:
    """members: (id, text_key) of every row; nodes: (node, id, text_key) of every different text, id the smallest that has
    it; linked: (a, b, n), see _verified(). node is a number that this run gave."""

    members: DataFrame
    nodes: DataFrame
    linked: DataFrame


def find(docs: DataFrame, id_col: str, text_col: str, like: Likeness | None = None) -> Found:
    """What is alike. Null texts and null ids are left out; a text with fewer words than a run is like equal texts only."""
    like = like or Likeness()
    plain = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    prints = materialize(plain.mapInArrow(_prints(like), "id string, text_key binary, n int, cls int, level int, bits binary"), "prints")
    # copies are combined before the shuffle
    texts = prints.filter("n > 0").groupBy("text_key").agg(F.min(F.struct("id", "n", "cls", "level", "bits")).alias("t")).select("text_key", "t.*")
    texts = materialize(texts, "texts")
    blocks = materialize(_laid_out(texts, like).groupBy("block").applyInArrow(_packed, _BLOCK), "tiles")
    drop_materialized(texts)
    nodes = blocks.select((F.shiftleft(F.col("block").cast("bigint"), ROW_BITS)).alias("first"), F.posexplode(F.arrays_zip("ids", "text_keys", F.sequence(F.lit(1), F.size("ids")).alias("i"))).alias("row", "t"))
    nodes = nodes.select((F.col("first") + F.col("row")).alias("node"), F.col("t.ids").alias("id"), F.col("t.text_keys").alias("text_key"))
    hang = components(_candidates(blocks, like), "near")
    cand = materialize(nodes.join(hang.select(F.col("id").alias("node"), F.col("component").alias("part")), "node"), "near")
    # chunks of a part by its bytes; small parts share a chunk
    lengths = prints.select("id", "text_key", "n").distinct()
    weighed = cand.join(lengths, ["id", "text_key"])
    of_part = weighed.groupBy("part").agg((F.sum("n") * 8).alias("bytes"))
    of_part = materialize(of_part.withColumn("chunks", F.ceil(F.col("bytes") / F.lit(like.chunk_bytes)).cast("int")), "parts")
    small = of_part.filter("chunks = 1").agg(F.sum("bytes")).first()[0] or 0
    bins = max(docs.sparkSession.sparkContext.defaultParallelism * 2, -(-small // like.chunk_bytes))
    placed = cand.join(of_part.select("part", "chunks"), "part")
    placed = placed.withColumn("chunk", F.when(F.col("chunks") > 1, F.pmod(F.xxhash64("node"), F.col("chunks"))).otherwise(0).cast("int"))
    # x, until pairs of chunks are made: the bin of a small part, else the part itself, below 0
    placed = placed.withColumn("x", F.when(F.col("chunks") > 1, -1 - F.col("part")).otherwise(F.pmod(F.xxhash64("part"), F.lit(bins))))
    held = plain.join(placed.select("id", "text_key", "node", "part", "x", "chunk", "chunks"), "id").select("text", "text_key", "node", "part", "x", "chunk", "chunks").filter("text is not null")
    sets = held.mapInArrow(_with_grams(like), "node bigint, part bigint, x bigint, chunk int, chunks int, grams binary").withColumnRenamed("x", "home")
    met = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    met = met.select("home", F.least("chunk", "other").alias("x"), F.greatest("chunk", "other").alias("y"), "part", "chunk", "node", "grams")
    linked = materialize(met.groupBy("home", "x", "y").applyInArrow(_verified(like), "a bigint, b bigint, n bigint"), "links")
    return Found(prints.select("id", "text_key"), nodes, linked)


def similar_texts(docs: DataFrame, id_col: str, text_col: str, like: Likeness | None = None) -> tuple[DataFrame, DataFrame]:
    """Links between different texts, and membership.

    Gives (a, b): representatives that belong to one group, as many pairs as connect it, and (id, representative) of every
    row that has an id and a text. Texts with the same runs have one representative, the smallest id. How many texts each
    is alike, groups() tells."""
    found = find(docs, id_col, text_col, like)
    name = lambda c, to: found.nodes.select(F.col("node").alias(c), F.col("id").alias(to))
    links = found.linked.filter("b is not null").join(name("a", "id_a"), "a").join(name("b", "id_b"), "b").select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    first = found.members.groupBy("text_key").agg(F.min("id").alias("representative"))
    return links, found.members.join(first, "text_key").select("id", "representative").distinct()


def _grouped(found: Found) -> DataFrame:
    """(id, text_key, node, group_id) of every row; node is null for texts without runs."""
    at = components(found.linked.filter("b is not null").select("a", "b"), "links")
    nodes = found.nodes.join(at.select(F.col("id").alias("node"), "component"), "node", "left").select("text_key", "node", F.coalesce("component", "node").alias("c"))
    rows = found.members.distinct().join(nodes, "text_key", "left").withColumn("key", F.coalesce(F.col("c").cast("string"), F.hex("text_key")))
    names = rows.groupBy("key").agg(F.min("id").alias("group_id"))
    return rows.join(names, "key").select("id", "text_key", "node", "group_id")


def membership(docs: DataFrame, id_col: str, text_col: str, like: Likeness | None = None) -> DataFrame:
    """(id, group_id) of every row with an id and a text, a group named by its smallest id."""
    return _grouped(find(docs, id_col, text_col, like)).select("id", "group_id").distinct()


def groups(docs: DataFrame, id_col: str, text_col: str, like: Likeness | None = None) -> DataFrame:
    """(id, group_id, n_links): membership() with the number of other texts that the row's text is alike.

    Every pair of texts that may be alike is compared on its sets, so n_links is exact whatever the size of a group; it is
    0 for a text that is like none. Rows with one id but different texts are rows of their own."""
    found = find(docs, id_col, text_col, like)
    n = found.linked.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n_links"))
    out = _grouped(found).join(n, "node", "left")
    return out.select("id", "group_id", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"))


def pairs(members: DataFrame) -> DataFrame:
    """(id, group_id) to (a, b): every pair of ids of a group, the smaller first.

    A group is cut into buckets of about PAIR_ROWS members, and each pair of buckets meets apart from the others, so that
    no task gets a group whole."""
    sizes = members.groupBy("group_id").agg(F.ceil(F.count("*") / PAIR_ROWS).cast("int").alias("buckets"), F.count("*").alias("n")).filter("n > 1").drop("n")
    rows = members.join(sizes, "group_id").withColumn("bucket", F.pmod(F.xxhash64("id"), F.col("buckets")).cast("int"))
    left = rows.select("group_id", F.col("id").alias("a"), F.col("bucket").alias("x"), F.explode(F.sequence("bucket", F.col("buckets") - 1)).alias("y"))
    right = rows.select("group_id", F.col("id").alias("b"), F.explode(F.sequence(F.lit(0), "bucket")).alias("x"), F.col("bucket").alias("y"))
    met = left.join(right, ["group_id", "x", "y"]).filter((F.col("x") != F.col("y")) | (F.col("a") < F.col("b")))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a != b")
