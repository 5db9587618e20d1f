"""Centroids, filter audit and suffix tree against brute force, with odd rows and forced splits."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm import centroids, filter_audit, packing, sharding, suffix_tree, token_files, url_filter
from folio.llm.tokens import vocabulary

RNG = np.random.default_rng(5)


# ---- centroids ----
def lloyd(rows, count, rounds):
    """(vec_id, cluster, distance) by full distances in Python integers, and the centroids."""
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    means = [v for _, v in sorted(kept, key=key)[:count]]
    distance = lambda v, m: sum((a - b) ** 2 for a, b in zip(v, m, strict=True))
    assign = lambda: [min((distance(v, m), c) for c, m in enumerate(means)) for _, v in kept]
    for _ in range(rounds):
        groups = defaultdict(list)
        for (_, c), (_, v) in zip(assign(), kept, strict=True):
            groups[c].append(v)
        for c, own in groups.items():
            means[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return sorted(((i, c, d) for (i, _), (d, c) in zip(kept, assign(), strict=True)), key=str), means


def vectors(n):
    base = RNG.normal(size=(n, 64)).astype(np.float32)
    base[n // 3 :: 2] = base[0]  # one vector on many rows, ties among equal centroids
    out = [(k, v.tolist()) for k, v in enumerate(base)]
    odd = [0.5] * 64
    return [*out, (n, None), (n + 1, odd[:63]), (n + 2, [*odd[:63], None]), (n + 3, [*odd[:63], float("nan")]), (n + 4, [*odd[:63], float("inf")]), (3, odd), (None, odd), (None, base[1].tolist())]


@pytest.mark.parametrize("n", [5, 300])
def test_clusters(spark, n):
    rows = vectors(n)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"v": F.lit("x"), "cluster": F.lit(1.5)})
    got = centroids.op11(df).collect()
    want, means = lloyd(rows, 40, 5)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=str) == want
    sums = Counter()
    for _, c, d in want:
        sums[c] += d
    for r in got:
        assert (r.cluster_inertia, r.inertia) == (sums[r.cluster], sum(sums.values()))
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, means[r.cluster])).encode()).hexdigest()


def test_no_vectors(spark):
    assert centroids.op11(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_components_out_of_reach_are_refused(spark):
    with pytest.raises(Exception, match="too large"):
        centroids.op11(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<float>")).collect()


def test_partial_distances_equal_full_ones():
    points, means = RNG.integers(-900, 900, (500, 64)), RNG.integers(-900, 900, (40, 64))
    means[7], means[30] = means[3], means[3]
    points[:50] = means[3]
    full = ((points[:, None, :] - means) ** 2).sum(axis=2)
    of, distance = centroids.nearest(points, means, RNG.permutation(64))
    assert (of == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()


# ---- filter audit ----
WORDS = [f"w{k}" for k in range(260)]
LONG = " ".join(WORDS * 900)
AUDITED = [
    (1, " ".join(WORDS), "en"), (2, " ".join(WORDS), "de"), (3, None, None), (4, "", ""), (5, "A B C", "en"), (6, "a $ b", "en"), (7, " ".join(["a"] * 300), "en"),
    (8, LONG, "en"), (9, LONG, "de"), (10, LONG[:-1] + "x", "en"), (11, LONG[:-1] + "y", "en"), (12, LONG[:-1] + "y", None), (5, "A B C", "en"), (None, "A B C", "en"), (None, "no id", "en"), (None, "no id", "en"),
    (13, "a | b", "en"), (14, " ".join(WORDS).upper(), "fr"), (15, "x\x1cy z " * 3, "fr"),
]
LABELS = [(1, 1, 0), (1, 0, 0), (2, 1, 1), (5, None, 1), (8, 1, None), (99, 1, 1), (None, 1, 1)]


def audited(rows, labels):
    """(part, order, step) -> the seven counts, straight from the definitions."""
    quality, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    texts = defaultdict(list)
    for i, t, _ in rows:
        texts[t or ""].append(math.inf if i is None else i)
    docs = []
    for i, t, lang in rows:
        text = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = ""
        fails += "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 3 * len(text)) + "D" * bool(re.search(r"[#$%&*|]", text))
        fails += "E" * (min(texts[text]) < (math.inf if i is None else i))
        docs.append((lang or "", set(fails), i in quality, i in toxic))
    out, shapley = {}, Counter()
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        for order in itertools.permutations("ABCDE"):
            for k, f in enumerate(order):
                before = set(order[:k])
                here = [d for d in own if f in d[1] and not d[1] & before]
                kept = sum(not d[1] & (before | {f}) for d in own)
                redundant = sum(f in d[1] and bool(d[1] & before) for d in own)
                out[part, "".join(order), k + 1] = [kept, len(here), redundant, sum(d[1] == {f} for d in own), sum(d[2] for d in here), sum(d[3] for d in here)]
                shapley[part, f] += len(here)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def by_key(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


@pytest.fixture(scope="module")
def audit_tables(spark):
    docs = spark.createDataFrame(AUDITED, "doc_id long, text string, lang string").withColumns({"n": F.lit(1), "part": F.lit("p"), "bits": F.lit(9), "least": F.lit(0)})
    return docs, spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumn("part", F.lit(2))


def test_audit(audit_tables):
    got = by_key(filter_audit.audit(*audit_tables))
    assert got == audited(AUDITED, LABELS) and len(got) == 5 * 600 - 600 * (5 - len({r[2] or "" for r in AUDITED}))


@pytest.mark.parametrize("few", [0, 100])
def test_audit_compares_texts_where_hashes_agree(audit_tables, few):
    docs, labels = audit_tables
    rows = filter_audit.masked(docs, digest=lambda c: F.length(c).cast("long") * 0, few=few)
    assert by_key(filter_audit.interactions(rows, labels)) == audited(AUDITED, LABELS)


def test_audit_of_nothing(spark, audit_tables):
    docs, labels = audit_tables
    assert filter_audit.audit(docs.where("false"), labels).collect() == []
    assert by_key(filter_audit.audit(docs, labels.where("false"))) == audited(AUDITED, [])


# ---- suffix tree ----
def tree_scores(rows, rules):
    """doc -> (held out, tokens, known, N, base, score), by dictionaries over whole texts."""
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2
    fold_ascii = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(i, fold(i), [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(fold_ascii)), "\n"]) for i, t in rows]
    single = Counter(w for _, train, ws in docs if train for w in ws)
    n, v = sum(single.values()), len(single)
    runs, seen = Counter(), Counter({("\n",): sum(train for _, train, _ in docs)})
    for _, train, ws in docs:
        path = ["\n", *ws] if train else []
        for k in range(1, len(path)):
            for d in range(1, rules.depth + 1):
                if k >= d:
                    runs[tuple(path[k - d : k]), path[k]] += 1
    for (c, w), m in runs.items():
        seen[(*c, w)] += m
    seen |= Counter({(w,): m for w, m in single.items()})
    by_context = defaultdict(list)
    for (c, w), m in runs.items():
        by_context[c].append((w, m))
    nodes = set()

    def p(context, w):
        for d in range(len(context), 0, -1):
            c = context[-d:]
            if c in nodes:
                more = seen[c] ** (2 / 3)
                return (runs[c, w] + more * p(c[1:], w)) / (seen[c] + more)
        return (single[w] + 1) / (n + v + 1)

    for d in range(1, rules.depth + 1):
        new = set()
        for c, following in by_context.items():
            if len(c) == d and seen[c] >= rules.least[d - 1]:
                more = seen[c] ** (2 / 3)
                gain = sum(m * math.log((m - 1 + more * p(c[1:], w)) / (seen[c] - 1 + more) / p(c[1:], w)) for w, m in following)
                if gain >= rules.gain * seen[c]:
                    new.add(c)
        nodes |= new
    out = []
    for i, train, ws in docs:
        path = ["\n", *ws]
        base = sum(math.log10((single[w] + 1) / (n + v + 1)) for w in ws)
        score = sum(math.log10(p(tuple(path[max(0, k - rules.depth) : k]), path[k])) for k in range(1, len(path)))
        out.append((i, not train, len(ws), sum(w in single for w in ws), n, round(base, 5), round(score, 5)))
    return sorted(out, key=str), nodes, p


def texts(n):
    """Words that follow each other by a rule half of the time."""
    out = []
    for k in range(n):
        words, at = [], int(RNG.integers(40))
        for _ in range(int(RNG.integers(3, 90))):
            at = (at * 7 + len(words) % 2) % 40 if RNG.random() < 0.5 else int(RNG.zipf(1.6)) % 60
            words.append(f"{'W' if at % 3 else 'w'}{at}")
        out.append((k, RNG.choice([" ", "\n", " \t "]).join(words)))
    return out


ODD = [(None, "w1 w2 w3 w1 w2"), (500, None), (501, ""), (502, " \n "), (7, "again w1"), (503, "x\x1cy éÉ İ  z"), (504, " ".join(f"w{k % 13}" for k in range(30_000)))]
RULES = suffix_tree.Rules(gain=0.05)


@pytest.mark.parametrize("rules", [RULES, suffix_tree.Rules(chunk=3000, cell=700, wide=40, gain=0.05), suffix_tree.Rules(depth=1, chunk=9000, cell=100, gain=0.0), suffix_tree.Rules(depth=3, least=(4, 6, 9), chunk=2000, wide=25, gain=0.02)], ids=["whole", "split", "flat", "deep"])
def test_suffix_tree(spark, rules):
    rows = [*texts(150), *ODD]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"chunk": F.lit("c"), "cell": F.lit(1), "trains": F.lit(None)}).repartition(3)
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in suffix_tree.scores(df, rules).collect()), key=str)
    want, nodes, _ = tree_scores(rows, rules)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-6)
    assert {len(c) for c in nodes} == set(range(1, rules.depth + 1))


def test_suffix_tree_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_tree.scores(empty).collect() == []
    only = spark.createDataFrame([(next(k for k in range(99) if zlib.crc32(str(k).encode()) % 7 == 2), "all held out")], "doc_id int, text string")
    (row,) = suffix_tree.scores(only).collect()
    assert row.asDict() == {"doc_id": row.doc_id, "held_out": True, "n_tokens": 4, "n_known": 0, "train_tokens": 0, "base_score": 0.0, "score": 0.0}


def test_distributions_sum_to_one():
    """Every node's distribution over the known words and one unseen one, in the definition that the operator equals."""
    rows = texts(60)
    _, nodes, p = tree_scores(rows, RULES)
    known = {w for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2 for w in [*t.lower().split(), "\n"]}
    assert nodes and all(abs(sum(p(c, w) for w in [*known, "never seen"]) - 1) < 1e-9 for c in [(), *nodes])


def test_model_beats_single_words_on_held_out_texts(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    one = suffix_tree.scores(d).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).head()
    assert one[0] > one[1] + 0.1 * one[2]


# ---- keys, ids, lengths and expressions of any kind ----
def test_a_key_has_one_shard_whatever_stands_beside_it(spark):
    big = [1152921504606846977, (1 << 63) - 1, -(1 << 63), (1 << 53) + 1, None, 7]
    out = {r.doc_id: (r.shard, r.grown_shard) for r in sharding.shard(spark.createDataFrame([(k, "t") for k in big], "doc_id long, text string").coalesce(1)).collect()}
    for k in big:
        alone = [int(sharding.jump(np.array([-1 if k is None else k], np.int64), n)[0]) for n in (16, 17)]
        assert out[k] == tuple(alone)
    kinds = {"string": ["a", "7", "", None], "int": [1, None, 7], "double": [0.5, None], "date": [None]}
    for kind, keys in kinds.items():
        rows = sharding.shard(spark.createDataFrame([(k, "t") for k in keys] * 2, f"doc_id {kind}, text string")).collect()
        by = defaultdict(set)
        for r in rows:
            by[r.doc_id].add((r.shard, r.grown_shard))
        assert len(rows) == 2 * len(keys) and all(len(x) == 1 for x in by.values()) and all(g in (s, 16) for x in by.values() for s, g in x)
        if kind == "int":
            assert by[7] == {out[7]}


@pytest.mark.parametrize("kind", ["int", "string", "bigint", "smallint"])
def test_token_files_of_ids_of_any_type(spark, kind):
    ids = [None, 3, 1, 2, 2] if kind != "string" else [None, "c", "a", "b", "b"]
    rows = [(i, f"some text number {k}") for k, i in enumerate(ids)]
    out = token_files.op5(spark.createDataFrame(rows, f"doc_id {kind}, text string").withColumn("part", F.lit(1)), vocabulary("word_bpe_49k.json"))
    assert out.schema["doc_id"].dataType.simpleString() == kind
    got = sorted(out.collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(ids, key=lambda x: (x is not None, x or 0 if kind != "string" else x or ""))
    assert [r.start for r in got] == list(np.cumsum([0, *(r.n_tokens for r in got[:-1])]))


@pytest.mark.parametrize("length", [1, 7, 257, 1009, 2039, 4099])
def test_sequences_of_any_length(spark, length):
    import time

    rows = [(k, " ".join(["word"] * int(n))) for k, n in enumerate(RNG.integers(0, 3 * min(length, 900), 150))]
    began = time.time()
    packing.patterns(RNG.integers(0, 500, length // -(-length // packing.CLASSES)), length // -(-length // packing.CLASSES))
    assert time.time() - began < 10
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary("word_bpe_49k.json"), length=length).collect()
    sequences, docs = defaultdict(list), defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append((r.start, r.length, r.doc_tokens))
    for own in sequences.values():
        own.sort()
        assert [a for a, _ in own] == list(np.cumsum([0, *(n for _, n in own[:-1])])) and sum(n for _, n in own) <= length
    for own in docs.values():
        own.sort()
        assert [a for a, *_ in own] == list(np.cumsum([0, *(n for _, n, _ in own[:-1])])) and sum(n for _, n, _ in own) == own[0][2]
    assert sorted(sequences) == list(range(len(sequences))) and len(docs) == len(rows)


def expression(depth=0):
    """A random regular expression over few characters."""
    pick = lambda *x: x[int(RNG.integers(len(x)))]
    one = lambda: pick("a", "b", "foo", "\\/", "/", "\\.", ".", "-", "[ab]", "[\\]ab]", "[^/]", "{", "a{1,2}", "b?", "/+", "x*", "\\d", "\\b", "^", "$", "(?=a)", "\\]", "[]a]") if RNG.random() < 0.3 else pick("foo", "a", "/", "\\/", "-")
    parts = [f"({pick('', '?:')}{expression(depth + 1)})" + pick("", "?", "*") if depth < 2 and RNG.random() < 0.15 else one() for _ in range(int(RNG.integers(2, 11)))]
    return "".join(parts) + (f"|{one()}" if RNG.random() < 0.1 else "")


def test_indexed_expressions_fit_what_all_expressions_fit():
    rules = []
    while len(rules) < 400:
        try:
            rules.append(url_filter.list_rule(f"/{pick}/" if (pick := expression()) else "/a/"))
        except re.error:
            continue
    rules.append(url_filter.list_rule("/(?i)\\/FOO\\//"))
    assert sum(bool(r.tokens) for r in rules) > 40
    urls = ["".join(RNG.choice(["a", "b", "foo", "/", ".", "-", "{", "]", "x", "1"], int(RNG.integers(1, 12)))) for _ in range(400)] + ["/bfoo/", "a{b/", "/foo/"]
    index = url_filter.Index(rules, {"foo": 50, "a": 9})
    for url in urls:
        text = f"//h.x/{url}"
        assert {id(r) for r in index.candidates(text) if r.search(text)} == {id(r) for r in rules if r.search(text)}


def test_broken_expressions_are_refused_with_their_line():
    assert url_filter.parse(["/[\\]ab]foo\\//", "/a{b\\//"])[0].search("//h.x/bfoo/")
    with pytest.raises(ValueError, match="line 3"):
        url_filter.parse(["! remark", "||a.b^", "/a(b/"])
