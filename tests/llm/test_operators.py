"""Operators against brute force, round trips, and odd rows: nulls, empty and long texts, repeats, empty tables, clashing names."""

from __future__ import annotations

import hashlib
import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm import byte_bpe, components, licenses, packing, quality, sharding, simhash, telephony, token_files, toxicity, url_filter
from folio.llm.tokens import vocabulary

WORDS = vocabulary("word_bpe_49k.json")
LONG = " ".join(f"w{k % 977}" for k in range(30_000))
TEXTS = [None, "", " \n\t ", "one", "Hello, World! 'tis naïve – 日本語 x̂", "a b c d e f g h i j k l", "the cat sat on the mat and then the dog ran away", "THE cat sat on the mat and then the dog ran away", "x" * 3000, LONG]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, kept boolean, size int"


def rows(texts):
    return [(k, t, None, "s", None, 0.5, 1, True, 3) for k, t in enumerate(texts)] + [(1, texts[1] if len(texts) > 1 else "", "en", None, 0, None, None, None, None), (None, "no id here at all", None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(TEXTS), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def jump_one(key: int, n: int) -> int:
    key, b, j = key % (1 << 64), -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_sharding(docs, empty):
    out = sharding.shard(docs).collect()
    assert len(out) == len(TEXTS) + 2
    for r in out:
        key = -1 if r.doc_id is None else r.doc_id
        assert r.shard == jump_one(key, 16) and r.grown_shard == jump_one(key, 17) and r.grown_shard in (r.shard, 16)
        if r.doc_id is not None:
            raw = (TEXTS[r.doc_id] or "").encode()
            assert (r["size"], r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")
    for _, own in itertools.groupby(sorted(out, key=lambda r: r.shard), key=lambda r: r.shard):
        slots = sorted(r.slot for r in own)
        assert slots == list(range(len(slots)))
    assert sharding.shard(empty).collect() == []


@pytest.mark.parametrize("shards", [1, 256, 1000])
def test_sharding_of_hot_keys(spark, shards):
    """A third of all rows share a key; any number of shards."""
    docs = spark.createDataFrame([(7 if k % 3 == 0 else None if k % 3 == 1 else k, "same") for k in range(3000)], "doc_id long, text string")
    out = sharding.shard(docs, shards).collect()
    own = {}
    for r in out:
        assert r.shard == jump_one(-1 if r.doc_id is None else r.doc_id, shards) and r.grown_shard in (r.shard, shards)
        own.setdefault(r.shard, []).append(r.slot)
    assert len(out) == 3000 and all(sorted(x) == list(range(len(x))) for x in own.values())


def quality_of(text):
    import re

    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    covered = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)} if len(grams) < 3000 else None
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), None if covered is None else len(covered)


def test_quality(spark, docs, empty):
    more = ["a b c d e a b c d e f", "x y\nx y\n \nx y", "## $$ |a| <b>", "a a a a a a a", "q w e r t y u i o p a s d f g"]
    texts = [*TEXTS, *more]
    out = {r.doc_id: r for r in quality.op2(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, t in enumerate(texts):
        want = quality_of(t)
        got = (out[k].n_words, out[k].word_chars, out[k].n_symbols, out[k].n_dup_lines, out[k].n_repeat_words)
        assert got[:4] == want[:4] and want[4] in (None, got[4])
        assert out[k].base_failed == (got[0] < 10 or 100 * got[4] > 20 * got[0])
        assert not (out[k].base_failed and out[k].kept)
    entries = quality.ledger(docs)
    effects = {r.rule: r for r in quality.ablations(entries).collect()}
    failed = [r.failed for r in entries.collect()]
    assert effects["few_words"].failing == sum(f & 1 for f in failed) and effects["few_words"].only == failed.count(1)
    assert quality.op2(empty).collect() == []
    assert entries.where(quality.kept_by("v1")).count() == failed.count(0)


def test_licenses(spark, docs, empty):
    header = licenses.TEMPLATES["mit-permission"]
    broken = header.split()
    broken[40] = "other"
    texts = [f"intro words here\n{header} and more", " ".join(broken), " ".join(header.split()[:30]), "all RIGHTS reserved", "x " * 500 + "Licensed under the Apache License, Version 2.0. " * 3, "rights all reserved", LONG + " Released under the MIT License."]
    got = {(r.doc_id, r.license_id): r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert set(got) == {(0, "mit-permission"), (1, "mit-permission"), (3, "all-rights-reserved"), (4, "apache-2.0"), (6, "mit")}
    assert got[0, "mit-permission"].containment == 1.0 and got[0, "mit-permission"].first_word == 3 and 0.8 <= got[1, "mit-permission"].containment < 1
    assert licenses.scan(docs).collect() == [] and licenses.scan(empty).collect() == [] and licenses.scan(docs, {}).collect() == []


def test_licenses_against_all_windows(spark):
    """Bands lose no window that holds 0.8 of a template: the same rows as SQL without bands."""
    import duckdb

    rng = np.random.default_rng(8)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for k in range(150):
        body = list(licenses.TEMPLATES.values())[k % len(licenses.TEMPLATES)].split()
        for at in rng.integers(0, len(body), rng.integers(0, 1 + len(body) // 25)):
            body[at] = "changed"
        filler = [f"f{x}" for x in rng.integers(0, 90, rng.integers(0, 300))]
        texts.append(" ".join([*filler, *body, *filler[::-1]]))
    documents = spark.createDataFrame([*enumerate(texts), (5, texts[-1]), (None, None)], "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", documents.toPandas().astype({"doc_id": "Int64"}))
    want = con.execute(licenses.ORACLE).fetchall()
    got = [tuple(r) for r in licenses.scan(documents).collect()]
    assert len(want) > 100 and sorted(got) == sorted(want)


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 102), (102, 101), (5, 5), (100, 102)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}


def test_simhash(spark, docs, empty):
    import xxhash

    def slow(text):
        w = text.encode().lower().split()
        if not w:
            return 0
        grams = [b" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))]
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    base = [f"t{k % 61}{k // 7}" for k in range(300)]
    texts = [*(t or "" for t in TEXTS[:-1]), *(" ".join([*base[:k], "new", *base[k + 1 :]]) for k in range(0, 300, 7)), " ".join(base)]
    got = {r.doc_id: r for r in simhash.op4(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    fps = [slow(t) for t in texts]
    assert [got[k].fingerprint for k in range(len(texts))] == [f"{f:016x}" for f in fps]
    root = list(range(len(texts)))
    for _ in texts:
        for a, b in itertools.combinations(range(len(texts)), 2):
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                root[a] = root[b] = min(root[a], root[b])
    assert [got[k].component_id for k in range(len(texts))] == root
    assert simhash.op4(empty).collect() == [] and len(simhash.op4(docs).collect()) == len(TEXTS) + 2
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.where("doc_id is not null").collect()).count(1) == 0


@pytest.mark.parametrize("hot", [1, simhash.HOT])
def test_simhash_links_are_complete(spark, hot):
    """Random chains of fingerprints: components equal those of all pairs, also where keys are split."""
    rng = np.random.default_rng(3)
    fps = [int(x) for x in rng.integers(-(1 << 63), 1 << 63, 40)]
    for _ in range(260):
        f = fps[rng.integers(len(fps))]
        for b in rng.choice(64, rng.integers(1, 7), replace=False):
            f ^= 1 << int(b) if b < 63 else -(1 << 63)
        fps.append(f)
    # many in one key that lie far apart
    fps += [(0x0102 << 48) + sum(int(x) << 8 * k for k, x in enumerate(rng.integers(0, 256, 4))) for _ in range(120)]
    fps = list(dict.fromkeys(fps))
    root = {f: f for f in fps}
    pairs = [(a, b) for a, b in itertools.combinations(fps, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4]
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    got = {r.fp: r.root for r in simhash.linked(spark.createDataFrame([(f,) for f in fps], "fp long"), hot=hot).collect()}
    assert {f: got.get(f, f) for f in fps} == root


def test_simhash_tally_decides(spark):
    """Pairs meet in a list from three shared positional bytes on; those of three are left out by the tally alone."""
    rng = np.random.default_rng(8)
    base = int(rng.integers(1 << 62))
    rows = []
    for shared in range(9):
        for chosen in itertools.combinations(range(8), 8 - shared):
            other = base
            for k in chosen:
                other ^= int(rng.integers(1, 128 if k == 7 else 256)) << 8 * k
            meet = any(not (base ^ other) & m & (1 << 64) - 1 for m in simhash.masks())
            rows.append((base, other, shared, meet))
    assert all(meet == (shared >= 3) for *_, shared, meet in rows)
    pairs = spark.createDataFrame(rows, "a long, b long, shared int, meet boolean")
    a, b = F.col("a"), F.col("b")
    got = pairs.withColumns({"tally": simhash.tally(a, b), "enough": simhash.counted(a, b, 4)}).collect()
    assert all(r.tally == r.shared and r.enough == (r.shared >= 4) for r in got)
    assert sum(r.meet and not r.enough for r in got) == 56


@pytest.mark.parametrize("distance", range(8))
def test_simhash_splits_keep_links(distance):
    """Whatever ``distance`` half bytes of a list's other positions differ, one of its finer sets has none of them."""
    whole = (1 << 64) - 1
    for mask, finer in list(zip(simhash.masks(distance), simhash.finer_masks(distance), strict=True))[:5]:
        rest = [n for n in range(16) if not mask >> 4 * n & 0xF]
        for differ in itertools.combinations(rest, min(distance, len(rest))):
            changed = sum(0xF << 4 * n for n in differ)
            assert any(not m & whole & changed for m in finer)


def test_deduplicated_drops_copies_of_similar_runs(spark):
    """Five-word Jaccard of 0.8 or more links texts whose fingerprints differ in more bits."""

    def runs(text):
        w = text.split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    texts, want = [], []
    for k in range(60):
        words = [f"w{k}x{j}" for j in range(60)]
        # a changed word in the middle costs 5 of 56 runs (0.84), two far ones 10 (0.70)
        one, two = [*words[:30], "new", *words[31:]], [*words[:20], "new", *words[21:40], "new", *words[41:]]
        texts += [" ".join(words), " ".join(one if k % 2 else two)]
    fps = [simhash.fingerprint(t) for t in texts]
    for k in range(0, 120, 2):
        a, b = runs(texts[k]), runs(texts[k + 1])
        bits = ((fps[k] ^ fps[k + 1]) & (1 << 64) - 1).bit_count()
        want += [k] if bits <= 4 or len(a & b) >= 0.8 * len(a | b) else [k, k + 1]
    assert any(((fps[k] ^ fps[k + 1]) & (1 << 64) - 1).bit_count() > 4 for k in range(2, 120, 4)) and len(want) > 60
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.deduplicated(docs).collect()) == want


def test_deduplicated_keeps_one_row_of_each_component(spark):
    """Whatever ids its rows have: repeated, null, or an id that heads another component."""
    a, b = (" ".join(f"{x}{j}" for j in range(50)) for x in "ab")
    rows = [(1, a), (1, a + " more"), (1, b), (2, b), (None, a), (None, "alone with no id"), (None, "alone  WITH no id"), (3, None), (3, ""), (4, "")]
    kept = simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(kept) == 4 and sorted((r.doc_id or 0) for r in kept) == [0, 1, 1, 3]


def direct_ids(text, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_token_files(docs, empty):
    out = token_files.op5(docs, WORDS).orderBy("start").collect()
    start = 0
    assert [r.doc_id for r in out] == sorted((r.doc_id for r in out), key=lambda d: (d is not None, d))
    for r in out:
        text = "no id here at all" if r.doc_id is None else TEXTS[r.doc_id]
        ids = direct_ids(text, 2)
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_files.op5(empty, WORDS).collect() == []


def test_token_files_of_split_parts(spark):
    """A part whose stored file is read by several tasks keeps its starts."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    texts = [f"w{k} " * (k % 90) + "one two" for k in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    conf.set("parquet.block.size", "4096")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        out = token_files.op5(docs, WORDS).orderBy("doc_id").collect()
    finally:
        conf.unset("parquet.block.size")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    from tokenizers import Tokenizer

    start = 0
    for r, e in zip(out, Tokenizer.from_file(WORDS).encode_batch(texts, add_special_tokens=False), strict=True):
        ids = np.array([*e.ids, 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_codes():
    rng = np.random.default_rng(1)
    counts = rng.zipf(1.2, 3000)
    bits = token_files.code_lengths(counts, 13)
    assert bits.max() <= 13 and (0.5 ** bits.astype(float)).sum() == 1
    small = np.array([1, 1, 2, 3, 5, 8, 13, 21])
    assert (token_files.code_lengths(small, 18) * small).sum() == 132  # the Huffman optimum
    codes = token_files.Codes(np.arange(3000), bits)
    ids = [rng.integers(0, 3000, n) for n in (1, 255, 256, 257, 5000)]
    made = [codes.encode(x) for x in ids]
    assert (codes.decode([p for p, _ in made], [c for _, c in made], np.array([len(x) for x in ids])) == np.concatenate(ids)).all()


def test_byte_bpe(docs, empty):
    import public_tokenizers as P
    import tiktoken

    path = vocabulary("byte_bpe_50k.tiktoken")
    ranks = byte_bpe.read_ranks(path)
    direct = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = byte_bpe.encode(docs, path, P.PATTERN, digests=True).where("doc_id is not null").collect()
    for r in out:
        text = TEXTS[r.doc_id] or ""
        ids = np.array(direct.encode_ordinary(text), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    bpe = byte_bpe.ByteBPE(ranks, P.PATTERN)
    for word in (b"internationalization", b"aaaaaaaaaaaaaaa", "čćžšđ".encode()):
        assert np.frombuffer(bpe.merge_many([word], 32)[0], "<u4").tolist() == bpe.merge_one(word)
    texts = byte_bpe.decode(byte_bpe.encode(docs, path, P.PATTERN), path).where("doc_id = 4").collect()
    assert texts[0].text == TEXTS[4] and byte_bpe.encode(empty, path, P.PATTERN).collect() == []


def test_segments():
    rng = np.random.default_rng(5)

    def slow(scores, a, b):
        """Ruzzo and Tompa's definition: the best segment, then both sides."""
        best = max(((sum(scores[i:j]), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
        if best[0] <= 0:
            return []
        *_, i, j = best
        return [*slow(scores, a, i), (best[0], i, j - 1), *slow(scores, j, b)]

    for _ in range(60):
        scores = [int(rng.integers(1, 6)) if rng.random() < 0.3 else -1 for _ in range(25)]
        hits = [(k, s) for k, s in enumerate(scores) if s > 0]
        want = slow(scores, 0, 25)
        assert sum(s for s, *_ in toxicity.segments(hits, -1)) == sum(s for s, *_ in want)
        assert {x[0] for x in toxicity.segments(hits, -1)} == {x[0] for x in want}
    many = toxicity.segments([(20 * k, 1.0) for k in range(200_000)], -0.1)  # linear: seconds, not hours
    assert len(many) == 200_000


def test_toxicity_model_against_brute_force(spark):
    """Log-odds, tail law and curve from direct counts."""
    import math

    rng = np.random.default_rng(9)
    data = []
    for k in range(600):
        words = [f"neutral{c}" for c in rng.choice(list("abcdefgh"), 30)]
        toxic = k % 5 == 0
        if toxic or rng.random() < 0.05:
            words[7] = "vile"
        data.append((" ".join(words), int(toxic)))
    labelled = spark.createDataFrame(data, "text string, toxic int")
    toxic, clean = sum(y for _, y in data), sum(1 - y for _, y in data)
    rows = {r.feature: r for r in toxicity.log_odds(labelled, toxic, clean).collect()}
    for feature, has in (("vile", lambda w: w == "vile"), ("neu*", lambda w: w.startswith("neu")), ("neutralb", lambda w: w == "neutralb")):
        a, b = (sum(sum(map(has, set(t.split()))) for t, y in data if y == c) for c in (1, 0))
        pseudo = 20 * (a + b + 0.5) / (toxic + clean + 1)
        assert (rows[feature].a, rows[feature].b) == (a, b)
        assert rows[feature].odds == pytest.approx(math.log((a + pseudo) / (toxic + 20)) - math.log((b + pseudo) / (clean + 20)))
    docs = spark.createDataFrame([(4 * k, t) for k, (t, _) in enumerate(data)], "doc_id long, text string")
    marks = spark.createDataFrame([(4 * k, y) for k, (_, y) in enumerate(data)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    used = [(t, y) for k, (t, y) in enumerate(data) if zlib.crc32(str(4 * k).encode()) % 4 != 2]
    assert "vile" in model.scores and not any(f.startswith("neu") for f in model.scores)
    found = [s for t, y in used if not y for s, *_ in model.passages(t, {})[0]]
    assert model.rate == pytest.approx(min(4.0, max(0.2, (len(found) + 1) / (sum(found) + 1))), rel=1e-5)
    assert model.k == pytest.approx((len(found) + 1) / (sum(30 for _, y in used if not y) + 1))
    x = np.array([model.evidence(*model.passages(t, {})) for t, _ in used])
    p, y = np.array([model.probability(e) for e in x]), np.array([y for _, y in used])
    assert abs((p - y).sum()) < 0.1 and abs(((p - y) * x).sum()) < 1  # the likelihood's gradient
    few = toxicity.fit(docs, marks, max_texts=300)
    assert "vile" in few.scores and few.k != model.k


def test_toxicity_held_out(spark):
    """Accuracy on labelled rows that were not learned from."""
    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.1/{name}.parquet")
    rows = toxicity.op7(read("documents"), read("labels")).where("held_out").join(read("labels"), "doc_id").select("predicted", "toxic").collect()
    both, said, is_so = sum(r.predicted * r.toxic for r in rows), sum(r.predicted for r in rows), sum(r.toxic for r in rows)
    assert both >= 0.9 * is_so and both >= 0.8 * said


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame([(k, f"fine words {k}" if k % 2 else "grumble grumble words", 1.0, "x") for k in range(400)] + [(None, "grumble", 1.0, None), (3, None, None, None), (3, "", None, None), (8, LONG, None, None), (8, LONG, None, None)], "doc_id long, text string, score double, toxic string")
    labels = spark.createDataFrame([(k, 1 - k % 2) for k in range(400)] + [(None, 1), (5, None), (5, 0), (5, 0)], "doc_id long, toxic int")
    out = toxicity.op7(docs, labels).collect()
    assert len(out) == 405 and all(0 <= r.score <= 1 for r in out) and len({r.score for r in out if r.doc_id is not None and r.doc_id % 2}) == 1
    assert [r.held_out for r in out if r.doc_id is None] == [False] and toxicity.scored(docs, toxicity.fit(docs, labels), "own").columns == [*docs.columns, "own"]


def test_toxicity(spark, empty):
    rng = np.random.default_rng(7)
    common = [f"{a}{b}" for a in ("wa", "lo", "mi", "ter") for b in ("na", "bo", "ke", "su", "ri")]
    data = []
    for k in range(900):
        words = list(rng.choice(common, 60))
        if k % 6 == 0:
            words[10] = rng.choice(["grumblefop", "grumblezit"])
            words[12] = "snarkhead"
        data.append((k, " ".join(words), int(k % 6 == 0)))
    data += [(900, "", None), (901, None, None)]
    docs = spark.createDataFrame([x[:2] for x in data], "doc_id long, text string")
    labels = spark.createDataFrame([(x[0], 1, x[2]) for x in data if x[2] is not None], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in toxicity.op7(docs, labels).collect()}
    assert all(out[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k in out)
    assert all(out[k].predicted == y for k, _, y in data if y is not None)
    assert out[900].predicted == out[901].predicted == 0 and out[900].score == out[901].score
    model = toxicity.fit(docs, labels)
    found = toxicity.toxic_passages(docs, model).where("doc_id = 6").collect()
    assert len(found) == 1 and "snarkhead" in found[0].passage
    assert toxicity.op7(empty, labels).collect() == [] and toxicity.op7(docs, labels.limit(0)).where("predicted = 1").count() == 0


def test_telephony(docs, empty):
    for table, tag in ((telephony.mulaw_table(), "mu"), (telephony.alaw_table(), "a")):
        assert len(set(table.tolist())) == (255 if tag == "mu" else 256)
    assert telephony.mulaw_table()[[0, 127, 128, 255]].tolist() == [-32124, 0, 32124, 0]
    assert telephony.alaw_table()[[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]

    def slow(block):
        pred, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
        out = [pred]
        for byte in block[4:]:
            for nib in (byte & 15, byte >> 4):
                step = int(telephony.STEPS[index])
                d = (step >> 3) + (step if nib & 4 else 0) + (step >> 1 if nib & 2 else 0) + (step >> 2 if nib & 1 else 0)
                pred = max(-32768, min(32767, pred - d if nib & 8 else pred + d))
                index = max(0, min(88, index + int(telephony.MOVES[nib & 7])))
                out.append(pred)
        return out

    blocks = np.random.default_rng(2).integers(0, 256, (5, 64)).astype(np.uint8)
    assert telephony.decode_adpcm(blocks).tolist() == [slow(b.tolist()) for b in blocks]
    ramp = np.arange(0, 8000, 100, dtype=np.int16)
    assert telephony.resample(ramp, 8000, 16000)[4:100].tolist() == list(range(200, 5000, 50)) and len(telephony.resample(ramp, 8000, 11025)) == 111
    x = np.random.default_rng(3).integers(-32768, 32768, 4001).astype(np.int16)
    half = [(2 * int(x[k]) + int(x[max(0, k - 1)]) + int(x[min(4000, k + 1)]) + 2) >> 2 for k in range(0, 4001, 2)]
    assert telephony.resample(x, 16000, 8000).tolist() == half
    try:
        telephony.CHUNK, telephony.BLOCKS, whole, b = 7, 2, telephony.CHUNK, telephony.BLOCKS
        assert telephony.resample(x, 16000, 8000).tolist() == half and telephony.resample(ramp, 8000, 16000)[4:100].tolist() == list(range(200, 5000, 50))
        features = telephony.feature("x", x)
    finally:
        telephony.CHUNK, telephony.BLOCKS = whole, b
    assert telephony.feature("x", x) == features
    for r in telephony.op8(docs).where("doc_id is not null").collect():
        raw = (TEXTS[r.doc_id] or "").encode()
        size = max(576, -(-len(raw) // 576) * 576)
        payload = raw.ljust(size, b"\xff")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), size, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert telephony.op8(empty).collect() == []
    tables = {"mulaw": telephony.mulaw_table(), "alaw": telephony.alaw_table()}
    for r in telephony.to_audio(docs).collect():
        codec, rate, block, data = telephony.read_wav(r.media)
        pcm = [s for k in range(0, len(data), block) for s in slow(data[k : k + block])] if codec == "ima_adpcm" else tables[codec][np.frombuffer(data, np.uint8)].tolist()
        want = telephony.resample(np.array(pcm, np.int16), 16000, 8000)
        assert (rate, r.rate) == (16000, 8000) and r.pcm == want.astype("<i2").tobytes()


def test_packing(docs, empty):
    out = packing.pack(docs, WORDS).collect()
    by_doc, by_sequence = {}, {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for k, t in enumerate(TEXTS):
        ids = direct_ids(t, 1)
        copies = 2 if k == 1 else 1
        pieces = sorted(by_doc[k], key=lambda r: r.start)
        assert sum(r.length for r in pieces) == copies * len(ids) and all(r.doc_tokens == len(ids) for r in pieces)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in pieces)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert packing.pack(empty, WORDS).collect() == []


@pytest.mark.parametrize("length", [100, 1001, 4096, 8192])
def test_packing_into_other_lengths(docs, length):
    sequences, total = {}, 0
    for r in packing.pack(docs, WORDS, length=length).collect():
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        total += r.length
    for own in sequences.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in itertools.pairwise(own)) and sum(own[-1]) <= length
    assert len(sequences) <= 1.1 * total / length + 3


def test_patterns():
    rng = np.random.default_rng(4)
    for demand in (rng.integers(0, 50, 64), np.bincount(rng.integers(0, 64, 5000), minlength=64), np.eye(64, dtype=int)[5] * 7, np.zeros(64, int)):
        chosen = packing.patterns(demand, 64)
        assert (sum((c * n for c, n in chosen), np.zeros(64, int)) == demand).all() and all((c * np.arange(1, 65)).sum() <= 64 for c, _ in chosen)
        least = -(-int((demand * np.arange(1, 65)).sum()) // 64)
        assert sum(n for _, n in chosen) <= 1.06 * least + 3


def test_url_filters(spark):
    urls = [None, "", "nothing", "https://www.Example.com/en/12", "http://example.com/en/71?x#y", "http://com/en/", "https://a.net/de/9#t", "https://x.example.net/de/8", "https://notexample.org/es/", "https://a.org/e", "http://a.b/Casino/x", "http://a.b/casinos", "ftp://HOST?q=/en/", "x://b.com/en"]
    urls += ["http://a.org/f.ZIP", "http://www.archive.org/f.zip", "http://a.b/ca\u017fino/x", "http://\u0130stanbul.b/XMLRPC.php", "http://a.b/" + "x/" * 5000 + "casino", "http://ads3.b.c/"]
    pages = spark.createDataFrame([(k, u, "h", "v") for k, u in enumerate(urls)] + [(3, urls[3], None, None), (None, urls[10], None, None)], "page_id long, url string, host string, verdict string")
    rows = url_filter.judge(pages).collect()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}
    assert len(rows) == len(urls) + 2 and got[None][3] == "block"
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("www.example.com", "/en/12", "com/en/", "block") and got[4] == ("example.com", "/en/71", "example.com/en/7", "allow")
    assert got[5][2:] == ("com/en/", "block") and got[6][2:] == ("net/de/", "block") and got[7][2:] == ("example.net/de/8", "block") and got[8][2:] == ("org/es/", "block")
    assert [got[k][3] for k in (9, 10, 11, 12, 13)] == ["allow", "block", "allow", "allow", "allow"] and got[12][:2] == ("host", "")
    assert [got[k][3] for k in range(14, 20)] == ["block", "allow", "allow", "block", "block", "block"]
    assert url_filter.judge(pages.limit(0)).collect() == [] and url_filter.judge(pages, []).where("verdict = 'block'").count() == 0

    import duckdb

    con = duckdb.connect()
    con.register("pages", pages.toPandas().astype({"page_id": "Int64"}))
    assert sorted(con.execute(url_filter.ORACLE).fetchall(), key=repr) == sorted(map(tuple, rows), key=repr)


def test_url_index_finds_what_all_rules_find():
    """Thousands of rules of every kind over random urls, other letters than ASCII among them."""
    rng = np.random.default_rng(6)
    bits = ["com", "net", "example", "casino", "en", "de", "7", "8", "a", "\u017f", "\u0130", "K", "AB", "ca\u017fino", "\u212a"]
    marks = [".", "/", "-", "_", "%", "~", ""]
    word = lambda n: "".join(rng.choice(bits) + rng.choice(marks) for _ in range(n))
    lines = ["! none", "", "/ads[0-9]+/", "/(com|net)\\/a/", "/^\\/\\/a\\.com\\//", "/x?casino\\/en/", "/a|b/"]
    for _ in range(3000):
        body = "".join(rng.choice([*bits, "*", "^", ".", "/", "-"]) for _ in range(rng.integers(1, 6)))
        lines.append(rng.choice(["", "@@"]) + rng.choice(["", "|", "||"]) + body + rng.choice(["", "|", "^"]))
    rules = [*url_filter.HOST_RULES, *url_filter.parse(lines)]
    urls = [("".join(x.translate(url_filter.FOLD) for x in word(3).replace("/", ".")), "/" + word(rng.integers(0, 6))) for _ in range(300)]
    every = [url_filter.Rule(r.verdict, r.name, r.expression, ()) for r in rules]
    index, scan = url_filter.Index(rules, {"com": 9, "a": 100}), url_filter.Index(every, {})
    assert sum(map(bool, (r.tokens for r in rules))) > 500 and len(index.always) < len(rules)
    for host, path in urls:
        text = f"//{host}{path}".translate(url_filter.FOLD)
        fits = lambda some: {(r.verdict, r.name, r.expression) for r in some if r.search(text)}
        assert fits(index.candidates(text)) == fits(scan.candidates(text)) and index.judge(host, path) == scan.judge(host, path)
    assert url_filter.list_rule("||a.b^casino^").tokens == ("a", "b", "casino") and url_filter.list_rule("casino").tokens == () and url_filter.list_rule("/\\/wp-login\\.php$/").tokens == ("wp", "login")


def test_word_encoder_equals_the_library():
    """Cached parts give the ids of whole texts, whatever letters, signs and spaces meet."""
    import random

    import pyarrow as pa

    from folio.llm.tokens import WordEncoder, vocabulary

    rnd = random.Random(5)
    letters = "aAbZéÉßÿÀİıŒµªº×÷ñ'’.,!?-()`[]{}~@#0 9\n\t\u00a0\u0301ẞ中ΣςσǅŉK\r<|>stremvld"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(60))) for _ in range(3000)]
    texts += ["<|endoftext|> <|startoftext|>", "it's 'start O'NEIL'S we'LL 'twas", "".join(map(chr, range(1, 0x250))), "", None]
    encoder = WordEncoder(vocabulary("word_bpe_49k.json"))
    want = [e.ids for e in encoder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for _ in range(2):
        ids, bounds = encoder.ids(pa.array(texts, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == want


def test_word_encoder_forgets(monkeypatch):
    """A small store, long pieces and many of them: the same ids."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    from folio.llm import tokens

    monkeypatch.setattr(tokens, "KEEP", 40)
    rng = np.random.default_rng(2)
    encoder, direct = tokens.WordEncoder(WORDS), Tokenizer.from_file(WORDS)
    for _ in range(12):
        texts = [" ".join("".join(rng.choice(list("abcdE\u00e9.,!1"), rng.integers(1, 6))) for _ in range(30)) + " " + "y" * 500 for _ in range(5)]
        ids, bounds = encoder.ids(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in itertools.pairwise(bounds)] == [e.ids for e in direct.encode_batch(texts, add_special_tokens=False)]
        assert len(encoder.store.keys) <= 40 + 150 and max(map(len, encoder.store.keys.to_pylist())) <= 64


def test_shared_folder_of_a_cluster():
    """A folder of one machine is an error where executors run elsewhere."""
    from types import SimpleNamespace

    from folio.llm.common import shared_dir

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None, applicationId="x")
    with pytest.raises(ValueError):
        shared_dir(SimpleNamespace(conf={}, sparkContext=context))
    assert shared_dir(SimpleNamespace(conf={"spark.checkpoint.dir": "hdfs://a/b/"}, sparkContext=context)) == "hdfs://a/b"


def test_special_strings_get_the_librarys_ids(spark):
    """A special token's string inside a text is that token, as for a plain tokenizer."""
    from tokenizers import Tokenizer

    texts = ["some text<|endoftext|>", "<|startoftext|> a <|endoftext|>b", "Word<|endoftext|>, <|endoftext", "<|EndOfText|> none"]
    want = [[*e.ids, 2] for e in Tokenizer.from_file(WORDS).encode_batch(texts, add_special_tokens=False)]
    assert 49407 in want[0] and 49406 in want[1]
    out = token_files.op5(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), WORDS).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.ids_crc32) for r in out] == [(len(w), zlib.crc32(np.array(w, "<u4").tobytes())) for w in want]


def test_sketches_rule_out_no_similar_texts(spark):
    """Every pair of a five-word Jaccard of 0.8 or more passes; most others don't."""
    rng = np.random.default_rng(12)
    pairs = []
    for k in range(400):
        words = [f"w{x}" for x in rng.integers(0, 10**6, rng.integers(20, 900))]
        other = list(words)
        for at in rng.integers(0, len(words), rng.integers(0, 2 + len(words) // 25)):
            other[at] = "new"
        pairs.append((" ".join(words), " ".join(other)))
    grams = [[simhash._grams(t)[1] for t in p] for p in pairs]
    share = [len(np.intersect1d(a, b)) / len(np.union1d(a, b)) for a, b in grams]
    rows = [(k, *(simhash._sketch(g)[1] for g in both)) for k, both in enumerate(grams)]
    kept = {r.k for r in spark.createDataFrame(rows, "k long, a array<long>, b array<long>").where(simhash.alike(F.col("a"), F.col("b"))).collect()}
    assert all(k in kept for k, s in enumerate(share) if s >= 0.8)
    assert sum(k in kept for k, s in enumerate(share) if s < 0.7) < 0.1 * sum(s < 0.7 for s in share) and sum(s < 0.7 for s in share) > 30


def test_deduplicated_finds_every_similar_pair_of_a_corpus(spark):
    """All documents: every pair of five-word Jaccard 0.8 or more, found over all runs, ends in one component."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.range(300).selectExpr("id + 100000", "'the same ten words of a text that many rows have'"))  # a third of the rows or so
    rows = {r.doc_id: set(simhash._grams(r.text or "")[1].tolist()) for r in docs.collect()}
    of_run, shared = {}, {}
    for k, runs in rows.items():
        for run in runs:
            of_run.setdefault(run, []).append(k)
    for same in of_run.values():
        for i, a in enumerate(same):
            for b in same[:i]:
                shared[a, b] = shared.get((a, b), 0) + 1
    pairs = [(a, b) for (a, b), n in shared.items() if 10 * n >= 8 * (len(rows[a]) + len(rows[b]) - n)]
    own = simhash.materialize(simhash._signatures(docs), "signatures")
    found = own.select("doc_id", "node").join(simhash._copies(docs, own, simhash.DISTANCE), "node", "left").selectExpr("doc_id", "coalesce(root, node) AS root")
    root = {r.doc_id: r.root for r in found.collect()}
    assert len(pairs) > 300 * 299 // 2 and all(root[a] == root[b] for a, b in pairs)
    assert [r.doc_id for r in simhash.deduplicated(docs).where("doc_id >= 100000").collect()] == [100000]
