"""Near-duplicate documents: SuperMinHash, banding, verification on full sets, union-find grouping."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import give_back, keep_rows, materialise
from annalist.llm.components import components
from annalist.llm.superminhash import band_keys, short_signature, signatures
from annalist.llm.textnum import LOWER, SPACE_SEP, Words, mix64, text_chunks, window_hashes

U = np.uint64
SHINGLE = 5
SLOTS = 252
BAND_ROWS = 6  # 42 bands: a pair at similarity 0.80 shares none with a chance of 3e-6, at 0.85 of 2e-9
SMALL = 16  # buckets up to this size are paired fully; larger ones by leader, again by sharp keys, and then in blocks
SHARP_ROWS, SHARP_KEYS = 16, 120  # at 0.80 one of them is shared with a chance of 0.97, at 0.85 of 0.9999
BLOCK = 256  # documents of up to BLOCK_ITEMS shingles in a block; a longer one counts for several
BLOCK_ITEMS = 2048
_subsets = np.random.default_rng(7)
_SHARP = np.stack([_subsets.choice(SLOTS, SHARP_ROWS, replace=False) for _ in range(SHARP_KEYS)])


def _shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted hashes of each document's distinct k-word shingles; of all its words, if it has fewer than k."""
    words = Words(LOWER[data], offsets, SPACE_SEP)
    hashes = words.hashes()
    grams = window_hashes(hashes, k)
    sets = []
    for lo, hi in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if hi - lo >= k:
            sets.append(np.unique(grams[lo : hi - k + 1]))
        elif hi > lo:
            sets.append(window_hashes(hashes[lo:hi], hi - lo))
        else:
            sets.append(grams[:0])
    return sets


def _sketch(k: int):
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("version", pa.int64()),
            ("n_shingles", pa.int64()),
            ("fp", pa.int64()),
            ("fp2", pa.int64()),
            ("keys", pa.list_(pa.int64())),
            ("sig", pa.binary()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(1)):
                sets = _shingle_sets(data, offsets, k)
                counts = np.array([len(s) for s in sets], dtype=np.int64)
                first = np.concatenate([[0], np.cumsum(counts)])
                items = np.concatenate(sets)
                sig = signatures(items, first, SLOTS)
                fps = []
                for seed in (0x51ED270B, 0x2545F491):
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(items ^ U(seed)))])
                    fps.append(pa.array((total[first[1:]] - total[first[:-1]]).view(np.int64)))
                keys = band_keys(sig, BAND_ROWS)
                n, bands = keys.shape
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(keys.view(np.int64).reshape(-1))
                )
                slots = (short_signature(sig) & np.uint32(0xFFFF)).astype("<u2")
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo).cast(pa.int64()),
                        batch.column(2).slice(lo, hi - lo),
                        pa.array(counts),
                        *fps,
                        lists,
                        pa.array([s.tobytes() for s in slots], pa.binary()),
                    ],
                    schema=schema,
                )
        give_back()

    return run, "doc_id long, version long, n_shingles long, fp long, fp2 long, keys array<long>, sig binary"


def _sharp_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("rep", pa.int64()), ("keys", pa.list_(pa.int64()))])
    for batch in batches:
        if not batch.num_rows:
            continue
        slots = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype="<u2").reshape(-1, SLOTS).astype(np.uint64)
        key = np.broadcast_to(np.arange(1, SHARP_KEYS + 1, dtype=np.uint64) << U(32), (len(slots), SHARP_KEYS)).copy()
        for r in range(SHARP_ROWS):
            key = mix64(key * U(0x9E3779B97F4A7C15) + slots[:, _SHARP[:, r]])
        cuts = pa.array(np.arange(len(slots) + 1, dtype=np.int32) * SHARP_KEYS)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.ListArray.from_arrays(cuts, pa.array(key.view(np.int64).reshape(-1)))], schema=schema
        )


def _sets(k: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("items", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(1)):
                sets = _shingle_sets(data, offsets, k)
                counts = pa.array([len(s) for s in sets], pa.int64())
                body = pa.array([s.tobytes() for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo).cast(pa.int64()), counts, body], schema=schema
                )
        give_back()

    return run, "doc_id long, n long, items binary"


def _verify(percent: int):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = batch.column(0), batch.column(1)
            good = np.zeros(batch.num_rows, dtype=bool)
            for i, (a, b) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                a, b = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
                if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
                    continue
                both = len(a) + len(b)
                merged = np.concatenate([a, b])
                merged.sort(kind="stable")
                common = int((merged[1:] == merged[:-1]).sum())
                good[i] = 100 * common >= percent * (both - common)
            keep = pa.array(good)
            yield pa.RecordBatch.from_arrays([u.filter(keep), v.filter(keep)], schema=schema)

    return run, "u long, v long"


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of ``left`` with each of ``right``."""
    both = left + right
    _, codes, counts = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(len(both)), [len(s) for s in both])
    again = counts > 1
    rows, codes = rows[again[codes]], (np.cumsum(again) - 1)[codes[again[codes]]]
    order = np.argsort(codes, kind="stable")
    rows, codes = rows[order], codes[order]
    out = np.zeros((len(left), len(right)), dtype=np.int64)
    width = 4096
    for lo in range(0, int(again.sum()), width):
        a, b = np.searchsorted(codes, [lo, lo + width])
        has = np.zeros((len(both), width), dtype=np.float32)
        has[rows[a:b], codes[a:b] - lo] = 1
        out += (has[: len(left)] @ has[len(left) :].T).astype(np.int64)
    return out


def _compare(percent: int):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        """Linked groups among all pairs of two blocks (side 0 and 1), or of one block with itself."""
        side = table.column("side").to_numpy()
        root = table.column("root").to_numpy()
        sets = [np.frombuffer(x, dtype=np.uint64) for x in table.column("items").to_pylist()]
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1) if side.any() else left
        size = np.array([len(s) for s in sets], dtype=np.int64)
        common = _common([sets[i] for i in left], [sets[i] for i in right])
        good = 100 * common >= percent * (size[left][:, None] + size[right][None, :] - common)
        i, j = np.nonzero(good & (root[left][:, None] != root[right][None, :]))
        u, v = root[left][i], root[right][j]
        pairs = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1), axis=0)
        return pa.Table.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)

    return run, "u long, v long"


def _families(buckets: DataFrame, groups: DataFrame) -> DataFrame:
    """(rep, root, family) of the larger buckets that still hold several groups; buckets that share members are a family."""
    hot = (
        buckets.filter(F.col("size") > SMALL)
        .join(groups, F.col("rep") == F.col("node"), "left")
        .select("key", "rep", "leader", F.coalesce("root", "rep").alias("root"))
    )
    several = hot.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("key")
    members = materialise(hot.join(several, "key", "left_semi").select("rep", "leader", "root").distinct(), "families")
    if members.isEmpty():
        return members.select("rep", "root", F.col("rep").alias("family"))
    one = components(members.select(F.col("leader").alias("u"), F.col("rep").alias("v")))
    return (
        members.select("rep", "root")
        .distinct()
        .join(one.select(F.col("node").alias("rep"), F.col("root").alias("family")), "rep", "left")
        .select("rep", "root", F.coalesce("family", "rep").alias("family"))
    )


def _within(families: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v: groups) between all members of a family that are in different groups.

    Members are dealt into blocks, and each two blocks are compared by one task
    at most.  Left out is only what cannot link: blocks of one and the same
    group, and sizes too far apart for ``percent``.
    """
    step = max(math.log(100 / percent), 0.01) * 1.0001  # sizes two classes apart differ by more than percent allows
    place = ["family", "class", "part"]
    members = families.join(sets.select(F.col("doc_id").alias("rep"), "n"), "rep").select(
        "rep", "root", "family", F.floor(F.log("n") / step).alias("class"), F.greatest(F.col("n") / BLOCK_ITEMS, F.lit(1.0)).alias("weight")
    )
    sized = members.groupBy("family", "class", "root").agg(F.sum("weight").alias("weight"))
    sized = sized.withColumn("part", F.when(F.col("weight") >= BLOCK, F.col("root")))  # blocks of its own for a large group
    counts = sized.groupBy(*place).agg(F.ceil(F.sum("weight") / BLOCK).alias("blocks"))
    name = lambda no: F.concat_ws("/", "family", "class", F.coalesce(F.col("part").cast("string"), F.lit("")), no)
    blocks = materialise(
        counts.withColumn("no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(*place, name(F.col("no")).alias("block")),
        "blocks",
    )
    a, b = (blocks.select("family", *[F.col(c).alias(f"{c}_{x}") for c in ("class", "part", "block")]) for x in "ab")
    meetings = a.join(b, "family").filter(
        "block_a <= block_b AND abs(class_a - class_b) <= 1 AND coalesce(part_a <> part_b, true)"
    )
    sides = F.when(
        F.col("block_a") == F.col("block_b"), F.array(F.struct(F.col("block_a").alias("block"), F.lit(0).alias("side")))
    ).otherwise(F.array(*[F.struct(F.col(f"block_{x}").alias("block"), F.lit(i).alias("side")) for i, x in enumerate("ab")]))
    placed = (
        members.join(sized.drop("weight"), ["family", "class", "root"])
        .join(counts.select(*[F.col(c).alias(f"_{c}") for c in place], "blocks"), F.expr("family = _family AND class = _class AND part <=> _part"))
        .select("rep", "root", name(F.pmod(F.xxhash64("rep"), F.col("blocks"))).alias("block"))
    )
    run, schema = _compare(percent)
    return (
        meetings.select("block_a", "block_b", F.inline(sides))
        .join(placed, "block")
        .join(sets.select(F.col("doc_id").alias("rep"), "items"), "rep")
        .select("block_a", "block_b", "side", "root", "items")
        .groupBy("block_a", "block_b")
        .applyInArrow(run, schema)
    )


def _buckets(keys: DataFrame, name: str) -> DataFrame:
    """(key, rep, leader, size) of buckets with two members or more; ``keys`` has rep and the list keys."""
    rows = keys.select("rep", F.explode("keys").alias("key"))
    sizes = rows.groupBy("key").agg(F.min("rep").alias("leader"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    return materialise(rows.join(materialise(sizes, f"{name}_sizes"), "key"), name)  # so that a hot key can be split


def _pairs(buckets: DataFrame) -> DataFrame:
    """Distinct pairs (u < v): each member with its bucket's leader, and all pairs of small buckets."""
    stars = buckets.filter("rep <> leader").select(F.col("leader").alias("u"), F.col("rep").alias("v"))
    small = buckets.filter(F.col("size").between(3, SMALL)).select("key", "rep")
    pairs = (
        small.select("key", F.col("rep").alias("u"))
        .join(small.select("key", F.col("rep").alias("v")), "key")
        .filter("u < v")
        .select("u", "v")
    )
    return stars.unionByName(pairs).distinct()


def near_dedup(
    docs: DataFrame, percent: int = 80, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest id reachable), kept.

    Documents are linked when 100 * |A and B| >= ``percent`` * |A or B| over
    their sets of distinct ``shingle``-word shingles (words: runs without ASCII
    white space, A-Z lower-cased; a shorter text is one shingle).

    1. Documents with the same set become one representative, however many.
    2. Representatives meet in 42 bands of their SuperMinHash signature.  Every
       member of a bucket is paired with its leader; small buckets are paired
       fully; the members of larger ones meet again under 120 sharper keys,
       with the same two rules.
    3. Each representative is first verified against the leader it shares most
       bands with; after these links are grouped, only pairs between different
       groups are verified.  Verification compares full sets.
    4. Where a larger bucket still holds several groups, all its members of
       different groups are compared, block by block.  So whoever shares a
       band has been compared, or is in one group already.
    5. Links are grouped by union-find.

    Texts without words have an empty set, link with nothing and stay; rows with
    a null id have a null component and stay; rows that repeat an id are
    judged each by its own text, and what is linked to one of them is in the
    component of their id; an empty table gives no rows; other columns are ignored.
    """
    return judged(docs, percent, shingle, id_col, text_col).drop("version")


def judged(docs: DataFrame, percent: int, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """The result of ``near_dedup``, with ``version``, a hash of each row's text."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("version")
    )
    run, schema = _sketch(shingle)
    sketches = materialise(rows.mapInArrow(run, schema), "sketches")
    known = sketches.filter("doc_id IS NOT NULL AND n_shingles > 0")
    # a class's representative: the smallest id, and of its texts in the class one
    classes = (
        known.groupBy("fp", "fp2", "n_shingles")
        .agg(F.min(F.struct("doc_id", "version")).alias("least"))
        .select("fp", "fp2", "n_shingles", F.col("least.doc_id").alias("rep"), F.col("least.version").alias("version"))
    )
    row = ["doc_id", "version"]
    reps = materialise(classes.select(F.col("rep").alias("doc_id"), "version"), "reps")
    keys = known.join(reps, row, "left_semi").dropDuplicates(row)
    buckets = _buckets(keys.select(F.col("doc_id").alias("rep"), "keys"), "buckets")

    best = (
        buckets.filter("rep <> leader")
        .groupBy("rep", "leader")
        .count()
        .groupBy("rep")
        .agg(F.max_by("leader", F.struct("count", -F.col("leader"))).alias("u"))
        .select("u", F.col("rep").alias("v"))
    )
    hot = buckets.filter(F.col("size") > SMALL).select("rep").distinct()
    sharp = (
        keys.select(F.col("doc_id").alias("rep"), "sig")
        .join(hot, "rep", "left_semi")
        .mapInArrow(_sharp_keys, "rep long, keys array<long>")
    )
    candidates = _pairs(buckets).unionByName(_pairs(_buckets(sharp, "sharp_buckets"))).distinct()

    paired = reps.join(buckets.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    run, schema = _sets(shingle)
    sets = materialise(
        rows.join(paired, row, "left_semi").dropDuplicates(row).select("doc_id", "text").mapInArrow(run, schema),
        "sets",
    )

    def verified(pairs: DataFrame) -> DataFrame:
        run, schema = _verify(percent)
        left = sets.select(F.col("doc_id").alias("u"), F.col("items").alias("a"))
        right = sets.select(F.col("doc_id").alias("v"), F.col("items").alias("b"))
        return pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(run, schema)

    links = materialise(verified(best), "links")
    groups = components(links)
    left = groups.select(F.col("node").alias("u"), F.col("root").alias("ru"))
    right = groups.select(F.col("node").alias("v"), F.col("root").alias("rv"))
    apart = (
        candidates.join(left, "u", "left")
        .join(right, "v", "left")
        .filter(F.coalesce("ru", "u") != F.coalesce("rv", "v"))
        .select("u", "v")
        .join(best, ["u", "v"], "left_anti")
    )
    more = materialise(verified(apart), "links")
    links = links.unionByName(more)
    groups = components(links)
    families = materialise(_families(buckets, groups), "families")
    if not families.isEmpty():
        groups = components(links.unionByName(materialise(_within(families, sets, percent), "links")))

    # written, so that both sides of the last join come by a shuffle of their own and a hot class can be split
    placed = materialise(
        classes.drop("version").join(groups, F.col("rep") == F.col("node"), "left").select(
            "fp", "fp2", "n_shingles", F.coalesce("root", "rep").alias("component")
        ),
        "classes",
    )
    return (
        sketches.select("doc_id", "version", "n_shingles", "fp", "fp2")
        .join(placed, ["fp", "fp2", "n_shingles"], "left")
        .select(
            "doc_id",
            "version",
            "n_shingles",
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def drop_near_copies(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group, the one with the smallest id; columns unchanged.

    Rows go by their own text: of an id that repeats with two texts, the one that is a copy goes and the other stays.
    """
    copies = judged(docs, percent, SHINGLE, id_col, text_col).select("doc_id", "version", "kept")
    return keep_rows(docs, copies, F.xxhash64(text_col), once=False, id_col=id_col)


def oracle_sql(percent: int = 85, shingle: int = SHINGLE) -> str:
    from annalist.llm.common import UPPER

    return f"""
    WITH RECURSIVE d AS MATERIALIZED (
        SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'),
                                   '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents
    ), s AS MATERIALIZED (
        SELECT DISTINCT doc_id, array_to_string(words[i:i + {shingle - 1}], ' ') AS g
        FROM d, LATERAL (SELECT unnest(range(1, greatest(len(words) - {shingle} + 1, least(len(words), 1)) + 1)) AS i)
    ), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    common AS (
        SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
        GROUP BY 1, 2
    ), links AS MATERIALIZED (
        SELECT u, v FROM common JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v
        WHERE 100 * c >= {percent} * (a.n + b.n - c)
    ), reach AS (
        SELECT doc_id, doc_id AS root FROM d
        UNION
        SELECT r.doc_id, l.v FROM reach r JOIN links l ON l.u = r.root
    ), least AS (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
    FROM d JOIN least USING (doc_id) LEFT JOIN n USING (doc_id)
    """
