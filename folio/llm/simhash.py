"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Fingerprints of 64 bits that differ in at most ``distance`` bits share at least 8 - distance bytes
at their positions. A list per (position, byte) would hold a 256th of all rows, so tallies over these
lists would look at a fixed share of all pairs. A list is therefore kept for each set of one position less
than the least tally and its bytes: for distance 4 the 56 sets of 3, each list with 1 of 2^24 unrelated
fingerprints. Pairs that meet in a list share 3 bytes for certain. The tally of their shared positional
bytes is then taken, those below the least tally go, and the others are verified by their differing bits.

No pairs are made at first: in the lists of eight sets the least and greatest fingerprint are compared with
every member, which joins most of a large group. Then the lists of all sets whose members are still in different
components are compared pair by pair where a list has at most HOT of them, and only links are kept.
Larger lists are split: of the half bytes outside a list's positions, in two equal parts, at most
``distance`` differ between linked members, so one part has at least half of the equal ones in common
(for distance 4: three of five, 20 sets of three half bytes).

Cases: null and empty texts have fingerprint zero and link like any other. Texts under four words
are one shingle; very long texts are hashed whole. Rows that repeat a doc_id keep a row each. A null
doc_id never names a component that has another id. Other columns of any name are not read by the
links and kept by ``deduplicated``. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh, id_and_text, materialize
from .components import components
from .tokens import release, small

SHINGLE = 4
DISTANCE = 4
#: Of near copies in a corpus: words of a run, least similarity in tenths, and the bands that find candidates.
GRAM, SHARE = 5, 8
BANDS, BAND = 20, 4
#: Members of a key that are compared pair by pair; a comparison takes some ten nanoseconds and lists nothing.
HOT = 2048
#: Of BANDS * BAND min-hash bytes those that two texts must share to be held against each other whole in the first
#: pass: at a similarity of 0.8 as few are shared with a chance of 1 in 200,000. And bits of a text's odd sketch.
ALIKE, ODD = 48, 640
#: Members of a run from which on they are first held against PICKS of them.
CROWD, PICKS = 32, 8
#: Texts that are looked through for frequent runs, how many of all texts must have one, and the most that are kept.
LOOKED, FREQUENT, MOST = 1 << 15, 16, 1 << 20
#: Bits that tell rows which surely are not in a set of rows from others, before a shuffle.
MARKS = 1 << 24
FACTORS, TERMS = np.random.default_rng(11).integers(0, 1 << 64, (2, BANDS * BAND), np.uint64) | np.array([[1], [0]], np.uint64)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of a text: ASCII lower case, words between ASCII white space, XXH64 with seed 42."""
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return 0
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    begins = (ends - sizes)[:n].tolist()
    hashes = [digest(line[a:b], 42) for a, b in zip(begins, ends[-n:].tolist(), strict=True)]
    total = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        part = np.array(hashes[k : k + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for whole in batches:
            for batch in small(whole):
                fps = [fingerprint(t or "") for t in batch.column("text").to_pylist()]
                yield pa.record_batch({"doc_id": batch.column("doc_id"), "fp": pa.array(fps, pa.int64())})

    return id_and_text(docs).mapInArrow(run, f"doc_id {kind}, fp long")


def keyed(distance: int = DISTANCE) -> int:
    """Positions of a list: one less than the least tally, so that the tally decides."""
    return max(1, 7 - distance)


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def masks(distance: int = DISTANCE) -> list[int]:
    """One signed 64-bit mask per set of ``keyed`` byte positions."""
    return [signed(sum(0xFF << 8 * k for k in chosen)) for chosen in combinations(range(8), keyed(distance))]


def finer_masks(distance: int = DISTANCE) -> list[list[int]]:
    """For each mask of ``masks`` signed masks of half bytes outside it: linked members agree in one of them."""
    out = []
    for chosen in combinations(range(8), keyed(distance)):
        rest = [n for k in range(8) if k not in chosen for n in (2 * k, 2 * k + 1)]
        half = len(rest) // 2
        least = (len(rest) - distance + 1) // 2
        sets = (some for part in (rest[:half], rest[half:]) for some in combinations(part, least))
        out.append([signed(sum(0xF << 4 * n for n in some)) for some in sets])
    return out


def tally(a: Column, b: Column) -> Column:
    """Positional bytes that two fingerprints share."""
    other = a.bitwiseXOR(b)
    return sum((F.when(F.shiftright(other, 8 * k).bitwiseAND(F.lit(255).cast("long")) == 0, 1).otherwise(0) for k in range(8)), F.lit(0))


def counted(a: Column, b: Column, distance: int) -> Column:
    """Count filter: whether a pair of a list reaches the least tally that a link guarantees."""
    return tally(a, b) >= 8 - distance


def near(a: Column, b: Column, distance: int) -> Column:
    return counted(a, b, distance) & (F.bit_count(a.bitwiseXOR(b)) <= distance)


def alike(a: Column, b: Column) -> Column:
    """Whether texts with these sketches (see ``_sketch``) may have a share of runs of SHARE / 10 in common.

    The odd sketches differ in at most as many bits as the sets do in runs, so they rule out none that has.
    """
    other = [F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k))) for k in range((BANDS * BAND + ODD // 8) // 8)]
    signs, odd = other[: BANDS * BAND // 8], other[BANDS * BAND // 8 :]
    unlike, apart = F.lit(0), F.lit(0)
    for x in signs:
        for shift in (4, 2, 1):  # a byte's lowest bit gets set by any of its own
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        unlike = unlike + F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))
    for x in odd:
        apart = apart + F.bit_count(x)
    runs = F.get(a, F.lit(len(other))) + F.get(b, F.lit(len(other)))
    return ((10 + SHARE) * apart <= (10 - SHARE) * runs) & (unlike <= BANDS * BAND - ALIKE)


def odd_alike(a: Column, b: Column) -> Column:
    """Of ``alike`` what rules out no similar pair: sizes, and the odd sketches."""
    at = BANDS * BAND // 8
    odd = [F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k))) for k in range(at, at + ODD // 64)]
    apart = sum((F.bit_count(x) for x in odd), F.lit(0))
    m, n = (F.get(x, F.lit(at + ODD // 64)) for x in (a, b))
    return (10 * F.least(m, n) >= SHARE * F.greatest(m, n)) & ((10 + SHARE) * apart <= (10 - SHARE) * (m + n))


def head_alike(a: Column, b: Column, m: Column, n: Column) -> Column:
    """Whether texts of m and n runs with these prefixes (see ``_head``) may be similar; rules out no similar pair.

    A prefix holds all of a set's runs before its last one, so before the lesser of the two last ones the sets are
    known whole, and differ there in no more runs than they may in all.
    """
    end = F.least(F.element_at(a, -1), F.element_at(b, -1))
    x, y = F.filter(a, lambda r: r < end), F.filter(b, lambda r: r < end)
    return (10 + SHARE) * (F.size(F.array_except(x, y)) + F.size(F.array_except(y, x))) <= (10 - SHARE) * (m + n)


def rest_pairs(labelled: DataFrame, key: list[str], finer: Column, link: Callable[[str, str], Column], more: DataFrame | None = None, hot: int = HOT, placed: bool = True, settle: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(u, v, root_u, root_v), stored: pairs of rows of ``labelled`` (key, node, root and others) that share a key,
    have different roots and pass ``link`` (of the endings of both rows' column names).

    Of a key with more than ``hot`` nodes only pairs that also share a value of ``finer`` (of a row with the columns of
    ``more``, by node) are compared (``placed``: at its place).

    Members of a key with more than CROWD nodes are first held against PICKS of them, where ``settle`` is given: it gets
    these pairs (u, v) and returns (node, root) with what links they have. That joins most of what belongs together in rows
    that grow with the members, not with their square; only keys that then still have several roots are compared whole.
    """
    apart = labelled.groupBy(*key).agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("__n")).where("lo < hi").select(*key, "__n")
    rest = materialize(labelled.join(apart.hint("merge"), key), "rest")
    both = [c for c in labelled.columns if c not in key]
    if settle is not None:
        crowd = rest.where(F.col("__n") > CROWD)
        members = crowd.select(*key, *(F.col(c).alias(f"{c}_u") for c in both))
        drawn = (F.min(F.struct(F.xxhash64("node", *key, F.lit(j)).alias("h"), *both)) for j in range(PICKS))
        picks = crowd.groupBy(*key).agg(F.array(*drawn).alias("p")).select(*key, F.explode(F.array_distinct(F.transform("p", lambda x: F.struct(*(x[c].alias(f"{c}_v") for c in both))))).alias("p")).select(*key, "p.*")
        tried = members.join(picks.hint("merge"), key).where(F.expr("root_u <> root_v") & link("u", "v"))
        roots = settle(tried.select(F.greatest("node_u", "node_v").alias("u"), F.least("node_u", "node_v").alias("v")))
        whole = rest.drop("root").join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node")).select(*rest.columns)
        mixed = whole.groupBy(*key).agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select(*key)
        settled = materialize(whole.join(mixed.hint("merge"), key).select(*rest.columns), "rest")
        discard(rest)
        rest = settled
    cell = [*key, "t", "l"]
    cold = rest.where(F.col("__n") <= hot).select(*key, F.lit(-1).alias("t"), F.lit(0).cast("long").alias("l"), *both)
    warm = rest.where(F.col("__n") > hot)
    warm = warm if more is None else warm.join(more.hint("merge"), "node")
    warm = warm.select(*key, F.inline(F.transform(finer, lambda x, i: F.struct((i if placed else F.lit(0)).alias("t"), x.cast("long").alias("l")))), *both)
    mixed = warm.groupBy(*cell).agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select(*cell)
    every = cold.union(warm.join(mixed, cell).select(*cold.columns))
    left, right = (every.select(*cell, *(F.col(c).alias(f"{c}_{x}") for c in both)) for x in "uv")
    pairs = left.join(right, cell).where(F.expr("node_u > node_v and root_u <> root_v") & link("u", "v"))
    found = materialize(pairs.select(F.col("node_u").alias("u"), F.col("node_v").alias("v"), "root_u", "root_v").distinct(), "apart")
    discard(rest)
    return found


def linked(fps: DataFrame, distance: int = DISTANCE, hot: int = HOT) -> DataFrame:
    """(fp, root) of every distinct fingerprint: components of the link graph."""
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def listed(rows: DataFrame, sets: list[int]) -> DataFrame:
        # up to 56 rows come of each: a shuffle of its own, by another key, is not merged as the small input would be
        return rows.repartition(n, F.xxhash64("node")).select("*", F.posexplode(F.array(*(F.col("node").bitwiseAND(F.lit(m)) for m in sets))).alias("s", "k"))

    own = fps.select(F.col("fp").alias("node")).distinct()
    # stars in a few lists join most of a large group, so that fewer of all lists are left with several components
    some = listed(own, [signed(sum(0xFF << 8 * ((k + i) % 8) for i in range(keyed(distance)))) for k in range(8)])
    ends = some.groupBy("s", "k").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi")
    # merged at every size: the optimizer takes postings for as small as the fingerprints they come from
    stars = some.join(ends.hint("merge"), ["s", "k"]).select(F.col("node").alias("u"), F.explode(F.array("lo", "hi")).alias("v"))
    first = components(stars.where(near(F.col("u"), F.col("v"), distance)))
    labelled = materialize(own.join(first, "node", "left").select("node", F.coalesce("root", "node").alias("root")), "labelled")
    finer = F.transform(F.element_at(F.array(*map(F.lit, finer_masks(distance))), F.col("s") + 1), lambda m: F.col("node").bitwiseAND(m.cast("long")))
    # what these stars leave apart inside a list, of all lists
    pairs = rest_pairs(listed(labelled, masks(distance)), ["s", "k"], finer, lambda u, v: near(F.col(f"node_{u}"), F.col(f"node_{v}"), distance), hot=hot)
    second = components(pairs.select(F.col("root_u").alias("u"), F.col("root_v").alias("v")))
    discard(pairs)
    joined = labelled.join(second.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    return joined.select(F.col("node").alias("fp"), F.coalesce("top", "root").alias("root"))


def _groups(docs: DataFrame, distance: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows: doc_id, fp; fingerprints: fp, root; components: root, component_id)."""
    own = materialize(fingerprints(docs), "fingerprints")
    least = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = materialize(least.join(linked(own, distance), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "roots")
    return own, roots, roots.groupBy("root").agg(F.min("least").alias("component_id"))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id): the least doc_id reachable over links, one row per row of ``docs``."""
    own, roots, heads = _groups(docs, distance)
    return own.join(roots.join(heads, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op4(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _row(docs: DataFrame) -> Column:
    """Hash of a row's text, null as empty: with the doc_id, what a row is known by."""
    return F.xxhash64(F.coalesce(docs["text"], F.lit("")))


def _grams(text: str) -> tuple[int, np.ndarray]:
    """(hash of the words, hashes of the distinct runs of GRAM words); a shorter text is one run, one without words has none."""
    import xxhash

    words = text.encode().lower().split()
    digest = xxhash.xxh64_intdigest
    runs = {digest(b" ".join(words[k : k + GRAM])) for k in range(max(1, len(words) - GRAM + 1))} if words else ()
    node = digest(b" ".join(words), 7)
    return node - (1 << 64) if node >> 63 else node, np.fromiter(runs, np.uint64, len(runs))


def _head(grams: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The prefix of a set of runs, one longer than a similar pair needs, in its order: 32 bits of each run that keep the order.

    All sets are put into one order, frequent runs last, else by hash. Two sets with a share of SHARE / 10 have at
    least a = ceil(SHARE / 10 * n) runs of each in common, n its size. So the first common run is among the first n - a + 1
    of both, and the first two (there are two, if the sets differ) are among the first n - a + 2.
    """
    n = len(grams)
    # frequent is sorted; np.isin would sort it again for every text
    often = frequent[np.minimum(np.searchsorted(frequent, grams), len(frequent) - 1)] == grams if len(frequent) else np.zeros(n, bool)
    order = np.lexsort((grams, often))[: n + (SHARE * -n // 10) + 2]
    high = grams[order] >> np.uint64(32)
    # frequent runs take the last 256th of the values
    return (np.where(often[order], np.uint64(255 << 24) + (high >> np.uint64(8)), high * np.uint64(255) >> np.uint64(8)).astype(np.int64) - (1 << 31)).astype(np.int32)


def _frequent(docs: DataFrame) -> np.ndarray:
    """Runs that FREQUENT or more texts have, as far as about LOOKED of them tell: at least two of these must have one.

    Only the lower half of the hashes is counted: prefixes begin there, and hold a run of the other half only if over
    three fifths of a text's runs are frequent. How many of the texts looked through must have a run falls as their share of all falls, so that the lists of the other runs don't
    grow with the table. At most MOST are kept, those of most texts. They only place runs in an order, so what is found is the
    same for any set of them.
    """
    every = max(1, docs.count() // LOOKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small(whole, limit=1_000_000):
                own = [_grams(t)[1] for t in dict.fromkeys(batch.column("text").to_pylist())]
                runs = np.concatenate([np.zeros(0, np.uint64), *own])
                yield pa.record_batch({"run": pa.array(runs[runs < 1 << 63].view(np.int64))})

    texts = id_and_text(docs).select("text").where(F.pmod(F.xxhash64("text", F.lit(5)), F.lit(every)) == 0)
    counts = texts.mapInArrow(run, "run long").groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    found = materialize(counts.where(F.col("n") >= max(2, FREQUENT // every)).withColumn("n", F.least("n", F.lit(1 << 10))), "frequent")
    least, total = 1 << 11, 0
    for n, runs in sorted(((r.n, r.runs) for r in found.groupBy("n").agg(F.count(F.lit(1)).alias("runs")).collect()), reverse=True):
        total += runs
        if total > MOST:
            break
        least = n
    kept = found.where(F.col("n") >= least).select("run").toArrow()
    discard(found)
    return np.sort(kept.column("run").to_numpy().view(np.uint64))


def _sketch(grams: np.ndarray) -> tuple[list[int], list[int]]:
    """(one signed hash per band of BAND min-hashes; as longs a byte of each min-hash, the parity of the
    runs of each residue by ODD, and the number of runs)."""
    if not len(grams):
        return [], []
    least = np.full(BANDS * BAND, (1 << 64) - 1, np.uint64)
    for k in range(0, len(grams), 4096):
        least = np.minimum(least, (grams[k : k + 4096, None] * FACTORS + TERMS).min(axis=0))
    import xxhash

    rows = least.reshape(BANDS, BAND)
    bands = np.array([xxhash.xxh64_intdigest(r.tobytes(), 3) for r in rows], np.uint64).view(np.int64)
    odd = np.packbits(np.bincount((grams % np.uint64(ODD)).astype(np.int64), minlength=ODD) & 1).view(np.int64)
    return bands.tolist(), [*(least >> np.uint64(24)).astype(np.uint8).view(np.int64).tolist(), *odd.tolist(), len(grams)]


def _signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, raw: hash of the text, node: hash of its words, fp, bands, sig: sketches, head: prefix) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(_frequent(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for whole in batches:
            for batch in small(whole):
                nodes, fps, bands, heads = [], [], [], []
                for t in batch.column("text").to_pylist():
                    node, grams = _grams(t)
                    nodes.append(node)
                    fps.append(fingerprint(t))
                    bands.append(_sketch(grams))
                    heads.append(_head(grams, shared.value))
                longs = [pa.array([b[k] for b in bands], pa.list_(pa.int64())) for k in (0, 1)]
                yield pa.record_batch({"doc_id": batch.column("doc_id"), "raw": batch.column("raw"), "node": pa.array(nodes, pa.int64()), "fp": pa.array(fps, pa.int64()), "bands": longs[0], "sig": longs[1], "head": pa.array(heads, pa.list_(pa.int32()))})

    own = id_and_text(docs)
    return own.withColumn("raw", _row(own)).mapInArrow(run, f"doc_id {kind}, raw long, node long, fp long, bands array<long>, sig array<long>, head array<int>")


def _one(at: Column) -> Column:
    """A long with the bit of ``at``'s rest by 64."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))


def maybe(rows: DataFrame, of: Column, chosen: DataFrame, wanted: bool = True) -> DataFrame:
    """``rows`` whose hash ``of`` may be in ``chosen`` (one column of hashes); not ``wanted``: those whose hash is not.

    A hash sets one of MARKS bits, and their words are broadcast: at most 64-th as many rows of two longs, whatever the size of
    ``chosen``. So the rows that surely are not wanted need no shuffle; of the others some are too many.
    """
    at = F.pmod(of, F.lit(MARKS))
    word, bit = fresh(rows, "__word"), fresh(rows, "__bit")
    only = F.pmod(F.col(chosen.columns[0]), F.lit(MARKS))
    words = chosen.select(F.shiftright(only, 6).alias(word), _one(only).alias(bit)).groupBy(word).agg(F.bit_or(bit).alias(bit))
    marked = F.coalesce(F.col(bit), F.lit(0).cast("long")).bitwiseAND(_one(at)) != 0
    return rows.withColumn(word, F.shiftright(at, 6)).join(F.broadcast(words), word, "left").where(marked if wanted else ~marked).select(*rows.columns)


def _grams_of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(node, grams) of the texts whose hash ``raw`` is in ``chosen`` and of some others, each once.

    Equal texts are merged by each task before they are dealt, so a large group of them meets nowhere.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small(whole, limit=1_000_000):
                both = [_grams(t) for t in dict.fromkeys(batch.column("text").to_pylist())]
                yield pa.record_batch({"node": pa.array([n for n, _ in both], pa.int64()), "grams": pa.array([g.view(np.int64) for _, g in both], pa.list_(pa.int64()))})

    own = id_and_text(docs)
    texts = maybe(own.select("text"), _row(own), chosen)
    return texts.mapInArrow(run, "node long, grams array<long>").dropDuplicates(["node"])


def _copies(docs: DataFrame, own: DataFrame, distance: int, hot: int = HOT) -> DataFrame:
    """(node, root) of the nodes linked by fingerprints or by a share of GRAM-word runs of at least SHARE / 10.

    Candidates are verified on the whole sets of runs. The first ones share a band and are alike by their sketches, which joins
    nearly all. What they leave apart is found without exception: each similar pair shares a run of its prefixes (see ``_head``).
    Of a run with more than ``hot`` texts pairs are compared that share a second one.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nodes = materialize(own.groupBy("node").agg(F.min("raw").alias("raw"), F.min("fp").alias("fp"), *(F.first(x).alias(x) for x in ("bands", "sig", "head"))), "nodes")
    grouped = nodes.select("node", "fp").join(linked(nodes, distance), "fp", "left").select("node", F.coalesce("root", "fp").alias("g"))
    by_bits = grouped.join(grouped.groupBy("g").agg(F.min("node").alias("v")), "g").select(F.col("node").alias("u"), "v").where("u <> v")
    postings = nodes.repartition(n, F.xxhash64("node")).select("node", F.posexplode("bands").alias("s", "k"))
    buckets = postings.groupBy("s", "k").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi")
    members = postings.join(buckets.hint("merge"), ["s", "k"])

    def verified(pairs: DataFrame) -> DataFrame:
        some = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
        grams = materialize(_grams_of(docs, nodes.join(some.hint("merge"), "node", "left_semi").select("raw")), "grams")
        a, b = (grams.select(F.col("node").alias(x), F.col("grams").alias(f"g_{x}")).hint("merge") for x in "uv")
        both = pairs.join(a, "u").join(b, "v").withColumn("__n", F.size(F.array_intersect("g_u", "g_v")))
        links = materialize(both.where(10 * F.col("__n") >= SHARE * (F.size("g_u") + F.size("g_v") - F.col("__n"))).select("u", "v"), "similar")
        discard(grams)
        discard(pairs)
        return links

    stars = members.select(F.col("node").alias("u"), F.explode(F.array("lo", "hi")).alias("v")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    sigs = [nodes.select(F.col("node").alias(x), F.col("sig").alias(f"sig_{x}")).hint("merge") for x in "uv"]
    stars = materialize(stars.join(sigs[0], "u").join(sigs[1], "v").where(alike(F.col("sig_u"), F.col("sig_v"))).select("u", "v"), "pairs")
    sure = materialize(by_bits.union(verified(stars)), "links")
    runs = F.get("sig", F.size("sig") - 1)
    rooted = nodes.select("node", runs.alias("runs"), "head").join(components(sure), "node", "left").repartition(n, F.xxhash64("node"))
    prefix = F.posexplode(F.slice("head", 1, F.greatest(F.lit(1), F.size("head") - 1))).alias("at", "k")
    postings = rooted.select("node", F.coalesce("root", "node").alias("root"), F.col("runs").cast("int").alias("runs"), prefix)

    def placed(u: str, v: str) -> Column:
        """Whether the run can be the first that a similar pair shares: enough runs follow it in both."""
        least = SHARE * (F.col(f"runs_{u}") + F.col(f"runs_{v}"))
        return ((10 + SHARE) * (F.col(f"runs_{u}") - F.col(f"at_{u}")) >= least) & ((10 + SHARE) * (F.col(f"runs_{v}") - F.col(f"at_{v}")) >= least)

    heads = [nodes.select(F.col("node").alias(x), F.col("head").alias(f"head_{x}"), runs.alias(f"runs_{x}")).hint("merge") for x in "uv"]

    def screened(pairs: DataFrame) -> DataFrame:
        pairs = pairs.distinct().join(sigs[0], "u").join(sigs[1], "v").where(odd_alike(F.col("sig_u"), F.col("sig_v"))).select("u", "v")
        return materialize(pairs.join(heads[0], "u").join(heads[1], "v").where(head_alike(*(F.col(c) for c in ("head_u", "head_v", "runs_u", "runs_v")))).select("u", "v"), "pairs")

    links = [sure]

    def settle(pairs: DataFrame) -> DataFrame:
        links.append(verified(screened(pairs)))
        return components(sure.union(links[-1]))

    apart = rest_pairs(postings, ["k"], F.filter("head", lambda x, i: i != F.col("at")), placed, nodes.select("node", "head"), hot, placed=False, settle=settle)
    pairs = screened(apart.select("u", "v"))
    discard(apart)
    found = components(sure.union(links[1]).union(verified(pairs)))
    for stored in links:
        discard(stored)
    return found


def deduplicated(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``docs`` with all its columns, one row of each component of near copies: its least (doc_id, hash of the text), null doc_ids last.

    Links are those of op4 and those of texts whose sets of five-word runs have a Jaccard similarity of
    0.8 or more, all of them (runs are told apart by 64-bit hashes).
    """
    own = materialize(_signatures(docs), "signatures")
    # the least row of each node first: equal texts are merged by each task, before anything is dealt by node
    firsts = own.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "raw")).alias("h"))
    roots = firsts.join(_copies(docs, own, distance).hint("merge"), "node", "left").select(F.coalesce("root", "node").alias("root"), "h")
    least = roots.groupBy("root").agg(F.min("h").alias("h"))
    head = materialize(least.select(F.col("h.doc_id").alias("__id"), F.col("h.raw").alias("__raw")), "heads")
    is_head = lambda rows, other: rows["doc_id"].eqNullSafe(other["__id"]) & (_row(rows) == other["__raw"])
    # only rows that may be left out are dealt to the heads, with their texts
    rows = own.select("doc_id", "raw")
    out = rows.join(head.hint("merge"), rows["doc_id"].eqNullSafe(head["__id"]) & (rows["raw"] == head["__raw"]), "left_anti").select(F.xxhash64("doc_id", "raw"))
    out = materialize(out, "out")
    named = F.xxhash64(docs["doc_id"], _row(docs))
    some = maybe(docs, named, out)
    kept = maybe(docs, named, out, wanted=False).union(some.join(head.hint("merge"), is_head(some, head), "left_semi"))
    again = own.groupBy(F.col("doc_id").alias("__id"), F.col("raw").alias("__raw")).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__id", "__raw")
    if again.isEmpty():
        return kept
    once = kept.join(again, is_head(kept, again), "left_semi")
    raw = fresh(docs, "__raw")
    once = once.withColumn(raw, _row(once)).dropDuplicates(["doc_id", raw]).drop(raw)
    return kept.join(again, is_head(kept, again), "left_anti").union(once)
