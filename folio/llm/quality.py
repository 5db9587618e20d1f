"""Quality rules as a bitmask ledger, in DataFrame functions only.

``ledger`` evaluates every rule once and stores its measurements and one failure bit per rule.
Policies are versioned masks over these bits, so a policy changes or is compared without reading a
text again; ``ablations`` gets every rule's effect on a policy by bitwise aggregation in one pass.

A text's words, lines and windows stay in arrays of its own row: nothing is exploded or shuffled.
Windows of five words are compared by 64-bit hashes inside one text.

Cases: null text is an empty text (no words, no lines, fails ``few_words``). A text under five
words has no window. Repeated rows get equal entries. An empty table gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, fresh, held

#: Symbols counted by ``n_symbols`` (fixed values).
SYMBOLS = "[#*$%&|<>]+"
WINDOW = 5

#: Rules in the order of their bits: name and failure over the measurements.
RULES: dict[str, Callable[[Callable[[str], Column]], Column]] = {
    "few_words": lambda m: m("n_words") < 10,
    "repeated_windows": lambda m: 100 * m("n_repeat_words") > 20 * m("n_words"),
    "symbols": lambda m: 100 * m("n_symbols") > 25 * m("n_words"),
    "repeated_lines": lambda m: 100 * m("n_dup_lines") > 50 * m("n_lines"),
    "short_words": lambda m: m("word_chars") < 2 * m("n_words"),
    "long_words": lambda m: m("word_chars") > 20 * m("n_words"),
}
#: Policies by version: names of the rules that reject.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "repeated_lines", "short_words", "long_words"),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def mask(policy: str) -> int:
    return sum(1 << k for k, name in enumerate(RULES) if name in POLICIES[policy])


def _covered(windows: Column) -> Column:
    """Words inside windows (hashes by position) that occur twice or more in the array."""
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def again(sorted_windows: Column) -> Column:
        def near(x: Column, k: Column) -> Column:
            same_before = F.get(sorted_windows, k - 1)["h"] == x["h"]
            same_after = F.get(sorted_windows, k + 1)["h"] == x["h"]
            return F.coalesce(same_before, F.lit(False)) | F.coalesce(same_after, F.lit(False))

        starts = F.array_sort(F.transform(F.filter(sorted_windows, near), lambda x: x["i"]))
        none = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        step = lambda a, i: F.struct((i + WINDOW).alias("end"), (a["n"] + WINDOW - F.greatest(F.lit(0), a["end"] - i)).alias("n"))
        return F.aggregate(starts, none, step, lambda a: a["n"])

    # a one-element array binds the sorted windows, so that they are made once
    return F.get(F.transform(F.array(placed), again), F.lit(0))


def measured(docs: DataFrame, text: Column, names: Sequence[str] = MEASURES) -> DataFrame:
    """``docs`` with all its columns and the measurements MEASURES of ``text`` in columns called ``names``."""
    t, w, h, lines = (fresh(docs, f"__{x}") for x in ("text", "words", "windows", "lines"))
    out = docs.withColumn(t, F.coalesce(text, F.lit("")))
    out = out.withColumn(w, F.filter(F.split(F.col(t), SPACE), lambda x: x != ""))
    out = out.withColumn(lines, F.filter(F.split(F.col(t), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    n = F.size(w)
    hashed = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(F.get(F.col(w), i + k) for k in range(WINDOW))))
    out = out.withColumn(h, F.when(n >= WINDOW, hashed).otherwise(F.array().cast("array<bigint>")))
    columns = {
        "n_words": n,
        "word_chars": F.length(F.array_join(w, "")),
        "n_symbols": F.length(t) - F.length(F.regexp_replace(t, SYMBOLS, "")),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_covered(F.col(h))),
    }
    return out.select(*docs.columns, held({k: v.cast("long") for k, v in zip(names, columns.values(), strict=True)}))


def failures(names: Sequence[str] = MEASURES) -> Column:
    """Failure bits over the measurement columns ``names``."""
    bits, column = F.lit(0).cast("long"), dict(zip(MEASURES, names, strict=True))
    for k, rule in enumerate(RULES.values()):
        bits = bits + F.when(rule(lambda name: F.col(column[name])), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long"))
    return bits


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, and ``failed``: the bits of all rules a text fails."""
    rows = measured(docs.select("doc_id", "text"), F.col("text")).select("doc_id", *MEASURES)
    return rows.withColumn("failed", failures())


def kept_by(policy: str, bits: str = "failed") -> Column:
    return F.col(bits).bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def ablations(entries: DataFrame, policy: str = "v1") -> DataFrame:
    """For each rule of a policy: texts that fail it, texts that only it rejects, and texts kept without it."""
    bits = {name: 1 << k for k, name in enumerate(RULES) if name in POLICIES[policy]}
    own = F.col("failed").bitwiseAND(F.lit(mask(policy)).cast("long"))
    sums = [F.count(F.lit(1)).alias("rows"), F.count_if(own == 0).alias("kept")]
    for name, bit in bits.items():
        sums += [F.count_if(own.bitwiseAND(F.lit(bit).cast("long")) != 0).alias(f"f_{name}"), F.count_if(own == bit).alias(f"o_{name}")]
    one = entries.agg(*sums)
    rows = F.array(*(F.struct(F.lit(n).alias("rule"), F.col(f"f_{n}").alias("failing"), F.col(f"o_{n}").alias("only"), (F.col("kept") + F.col(f"o_{n}")).alias("kept_without")) for n in bits))
    return one.select(F.explode(rows).alias("x")).select("x.*")


def op2(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """doc_id, the contract's measurements, base_failed and kept of every document; ``failed`` holds the bits."""
    return ledger(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~kept_by("base")).alias("base_failed"), kept_by(policy).alias("kept"), "n_lines", "failed")


#: The same as DuckDB SQL.
ORACLE = r"""WITH w AS (SELECT doc_id, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
  win AS (SELECT doc_id, i, array_to_string(words[i:i+4], ' ') AS s FROM w, unnest(range(1, len(words) - 3)) AS r(i)),
  dup AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM win),
  rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM dup, unnest(range(0, 5)) AS r(k) WHERE n > 1 GROUP BY doc_id),
  m AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
      (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
      (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
    FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id),
  f AS (SELECT *, ((n_words < 10)::INT + 2 * (100 * n_repeat_words > 20 * n_words)::INT + 4 * (100 * n_symbols > 25 * n_words)::INT
      + 8 * (100 * n_dup_lines > 50 * n_lines)::INT + 16 * (word_chars < 2 * n_words)::INT + 32 * (word_chars > 20 * n_words)::INT)::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, n_lines, failed FROM f"""
