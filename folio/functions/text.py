"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = r"(?U)^\s+|\s+$"


def strip(x: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(x, WHITE, "")


def collapse(x: Column) -> Column:
    """White-space runs as one space, none at the ends."""
    return strip(F.regexp_replace(x, r"(?U)\s+", " "))


def escape_like(term: str) -> str:
    return term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def contains_any_case(x: Column, term: str) -> Column:
    """Case-insensitive substring match in which % and _ are ordinary characters."""
    return x.ilike(f"%{escape_like(term)}%")


def tokens(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def paper_text(title: Column, abstract: Column) -> Column:
    """Title and abstract, stripped, blanks left out, joined by a space."""
    return F.concat_ws(" ", F.nullif(strip(title), F.lit("")), F.nullif(strip(abstract), F.lit("")))


def bare_doi(doi: Column) -> Column:
    return F.regexp_replace(doi, r"^https?://doi\.org/", "")


def strip_markup(x: Column) -> Column:
    return strip(F.regexp_replace(x, "<[^>]+>", ""))


def doi_source(doi: Column) -> Column:
    return F.when(doi.contains("10.1007"), "springer").when(doi.contains("10.1016"), "elsevier").otherwise("html_generic")


def classify_status(status: Column) -> Column:
    return F.when(status == 200, "ok").when(status.isin(404, 410), "dead").otherwise("unknown")


#: Fixed value: a preprint number with its version in an address or a doi.
ARXIV = r"(?i)(?:arxiv\.org/abs/|10\.48550/arXiv\.)(\d{4}\.\d{4,5}(?:v\d+)?)"


def arxiv_id(doi: Column, pages: Column) -> Column:
    """The preprint number, with its version, in the doi, else in the first landing page that has one; null without."""
    found = F.transform(F.concat(F.array(doi), F.coalesce(pages, F.array().cast("array<string>"))), lambda x: F.regexp_extract(F.coalesce(x, F.lit("")), ARXIV, 1))
    return F.get(F.filter(found, lambda x: x != ""), F.lit(0))


def vector_literal(vector: list[float]) -> str:
    """A vector as text, seven significant digits a component."""
    return "[" + ",".join(f"{x:.7g}" for x in vector) + "]"


def held(**columns: Column) -> Column:
    """``columns`` as one generated row, for a select: each is made once a row, whatever later steps name it how often."""
    return F.inline(F.array(F.struct(*(v.alias(k) for k, v in columns.items()))))


def inverted(rows: DataFrame, words: str, name: str) -> DataFrame:
    """``rows`` with ``name`` for their array ``words``: each word's positions from 0, as a map (null for null). Nothing is shuffled."""
    own = [c for c in rows.columns if c != words]
    pairs = rows.select(*own, held(__s=F.array_sort(F.transform(words, lambda x, i: F.struct(x.alias("word"), i.alias("at"))))))
    word = lambda i: F.get("__s", i)["word"]
    begins = F.filter(F.sequence(F.lit(0), F.size("__s")), lambda i: (i < F.size("__s")) & ((i == 0) | (word(i) != word(i - 1))))
    begun = pairs.select(*own, "__s", held(__b=begins))
    places = lambda a, k: F.transform(F.slice("__s", a + 1, F.coalesce(F.get("__b", k + 1), F.size("__s")) - a), lambda x: x["at"])
    return begun.select(*own, F.map_from_entries(F.transform("__b", lambda a, k: F.struct(word(a).alias("word"), places(a, k).alias("positions")))).alias(name))


def rebuilt_abstract(index: Column) -> Column:
    """Text of an inverted index (word to positions); of words at one position the last entry's stays; null without words."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    numbered = F.transform(pairs, lambda x, i: F.struct(x["p"].alias("p"), i.alias("i"), x["w"].alias("w")))
    # The sorted array is bound to a lambda variable: named inside the filter, it would be sorted again for every element.
    last_of = lambda o: F.filter(o, lambda x, i: F.coalesce(F.get(o, i + 1)["p"] != x["p"], F.lit(True)))
    last = F.get(F.transform(F.array(F.array_sort(numbered)), last_of), F.lit(0))
    return F.nullif(F.array_join(F.transform(last, lambda x: x["w"]), " "), F.lit(""))


def hash_vector(text: Column, dim: int) -> Column:
    """Deterministic stand-in for an embedding: bytes of sha256(text#0), sha256(text#1), ... scaled to -1..1."""

    def part(r: Column) -> Column:
        digest = F.sha2(F.concat(text, F.lit("#"), r.cast("string")), 256)
        return F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.conv(F.substr(digest, 2 * k + 1, F.lit(2)), 16, 10).cast("double") / 255 * 2 - 1)

    rounds = -(-dim // 32)
    return F.slice(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(rounds - 1)), part)), 1, dim)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null where a norm is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
