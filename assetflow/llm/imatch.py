"""Document fingerprints: hashes of a document's telling terms, under several randomised lexicons.

1. *Lexicon.* Terms are runs of letters, digits and characters beyond ASCII, in lower case. Kept are those in a band of inverse
   document frequency: at least one document in ``RAREST`` and at most one in ``COMMONEST`` has the term.
2. *Subsets.* ``BYTES`` bytes of a term's MD5 decide to which subsets of the lexicon it belongs: for each byte there is one with
   a quarter of all terms, in it one with a 16th, a 64th and a 256th. Large subsets notice any change, small ones outlive an edit.
3. *Fingerprint.* A document's distinct terms are sorted; for each subset those in it are hashed together. The likeness of two
   fingerprints is the share of subsets with equal hashes among those in which either has a term; equal fingerprints have 1.

Scale: everything is a DataFrame expression. Document frequencies are summed before they are shuffled. At most ``RAREST`` times the
mean number of distinct terms in a document can be in so many documents, whatever the size of the table (a sum of frequencies
over their least value), so the lexicon has a bounded size and goes to the tasks as a constant: membership, subsets and hashes
are worked out in the row. ``edited_fingerprints`` shuffles texts by document and a part of each to the one before it.

Defined results: a null text is empty; texts of any length are taken whole; a text without terms of the lexicon has a hash of
none in each subset (``--------``); equal texts have equal fingerprints; documents are ordered by id (null first), then by a
checksum of the text; rows of one id and text are one document, whose result each of them gets; the one document of a table comes after
itself; an empty table gives an empty table; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.windows import ranked
from .common import cut

#: The band: a term's share of documents is between one in RAREST and one in COMMONEST.
RAREST, COMMONEST = 500, 20
BYTES, MASKS = 7, (3, 15, 63, 255)
SUBSETS, DIGITS = BYTES * len(MASKS), 8
NO_TERMS = "-" * DIGITS
#: Lists that the lexicon is dealt to, so that a term is sought among a few.
LISTS = 1 << 14


def _terms(text: Column) -> Column:
    return F.array_distinct(F.split(F.lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"))


def _list_of(term: Column) -> Column:
    return F.pmod(F.hash(term), F.lit(LISTS))


def lexicon(docs: DataFrame, text: str = "text", rarest: int = RAREST, commonest: int = COMMONEST) -> DataFrame:
    """(term, df) of the terms in the band."""
    total = docs.count()
    counts = docs.select(F.explode(_terms(F.col(text))).alias("term")).where("term <> ''").groupBy("term").agg(F.count("*").alias("df"))
    return counts.where((F.col("df") * rarest >= total) & (F.col("df") * commonest <= total))


def _constant(terms: DataFrame) -> Column:
    """The lexicon as an array of lists, each term between blanks: a text that Spark splits once, when it plans."""
    lists = terms.groupBy(_list_of(F.col("term")).alias("at")).agg(F.array_join(F.sort_array(F.collect_list("term")), " ").alias("terms"))
    out = [""] * LISTS
    for at, found in lists.collect():  # bounded, see above
        out[at] = f" {found} "
    return F.split(F.lit("\n".join(out)), "\n")


def _numbered(terms: Column) -> Column:
    """Sorted terms, each with the first 60 bits of its MD5."""
    number = lambda t: F.conv(F.substring(F.md5(t), 1, 15), 16, 10).cast("long")
    return F.transform(F.sort_array(terms), lambda t: F.struct(number(t).alias("number"), t.alias("term")))


def _level(name: str, k: int) -> Column:
    """The subsets of a level, one for each byte. Each level takes from the one before: its subsets lie in those. No column is
    named within a lambda, where Spark would work it out again for each element."""

    def within(terms: Column | str, byte: Column) -> Column:
        return F.filter(terms, lambda x: F.call_function("shiftright", x["number"], byte * 8).bitwiseAND(F.lit(MASKS[k])) == 0)

    if k == 0:
        return F.array(*[within(f"__0{name}", F.lit(b)) for b in range(BYTES)])
    return F.transform(f"__{k}{name}", lambda terms, b: within(terms, b))


def fingerprinted(df: DataFrame, texts: dict[str, str], lists: Column) -> DataFrame:
    """``df`` with a fingerprint for each text column: ``texts`` names them by the new columns. Texts aren't null."""
    known = lambda t: F.element_at(lists, _list_of(t) + 1).contains(F.concat(F.lit(" "), t, F.lit(" ")))
    for name, text in texts.items():
        df = df.withColumn(f"__0{name}", _numbered(F.filter(_terms(F.col(text)), known)))
        for k in range(len(MASKS)):
            df = df.withColumn(f"__{k + 1}{name}", _level(name, k))
        hashed = lambda a: F.when(F.size(a) == 0, NO_TERMS).otherwise(F.substring(F.md5(F.array_join(F.transform(a, lambda x: x["term"]), " ")), 1, DIGITS))
        all_ = F.concat(*[f"__{k}{name}" for k in range(1, len(MASKS) + 1)])
        df = df.withColumn(name, F.array_join(F.transform(all_, hashed), "")).drop(*[f"__{k}{name}" for k in range(len(MASKS) + 1)])
    return df


def likeness(a: Column, b: Column) -> Column:
    """Share of subsets with equal hashes among those in which either fingerprint has terms."""
    part = lambda f, i: F.substring(f, i * DIGITS + 1, F.lit(DIGITS))
    places = F.sequence(F.lit(0), F.lit(SUBSETS - 1))
    same = F.size(F.filter(places, lambda i: (part(a, i) == part(b, i)) & (part(a, i) != NO_TERMS)))
    any_ = F.size(F.filter(places, lambda i: (part(a, i) != NO_TERMS) | (part(b, i) != NO_TERMS)))
    return F.when(a == b, 1.0).otherwise(same / any_)


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", rarest: int = RAREST, commonest: int = COMMONEST) -> DataFrame:
    """(``id``, fingerprint) per row."""
    own = docs.select(F.col(id).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    return fingerprinted(own, {"fingerprint": "text"}, _constant(lexicon(own, "text", rarest, commonest))).select(F.col("id").alias(id), "fingerprint")


#: A document's key: its id as text, whether it has none, and the checksum of its text. All are never null, so joins and groups
#: by them share one partitioning.
_KEY = ["id_text", "no_id", "check"]


def _neighbours(own: DataFrame) -> DataFrame:
    """Key, id and n of each document, and key and n of the one before it (``before_*``); before the first comes the last."""
    placed = cut(ranked(own.groupBy(*_KEY, "id").agg(F.first("n").alias("n")), [F.asc_nulls_first("id"), F.asc("check")], "place"))
    total = placed.count()
    before = placed.select(((F.col("place") + 1) % max(total, 1)).alias("place"), *[F.col(c).alias(f"before_{c}") for c in (*_KEY, "n")])
    return cut(placed.join(before, "place").drop("place"))


def edited_fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", rarest: int = RAREST, commonest: int = COMMONEST) -> DataFrame:
    """(``id``, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next): each document beside itself with
    the latter half of its characters replaced by the first ones of the next document."""
    own = docs.select(F.col(id).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    own = own.withColumns({"id_text": F.coalesce(F.col("id").cast("string"), F.lit("")), "no_id": F.col("id").isNull(), "check": F.xxhash64("text")})
    lists = _constant(lexicon(own, "text", rarest, commonest))
    around = _neighbours(own.withColumn("n", F.char_length("text").cast("long"))).withColumnsRenamed({c: f"__{c}" for c in _KEY})
    same = lambda a, b: [F.col(f"{a}{c}") == F.col(f"{b}{c}") for c in _KEY]
    # Both uses of the join read the same columns of the texts, so that Spark shuffles these once.
    placed = fingerprinted(own.drop("id").join(around, same("", "__")), {"fingerprint": "text"}, lists)
    # Each document's first characters and fingerprint go to the document before it, as many as that one replaces.
    before = [f"before_{c}" for c in _KEY]
    heads = placed.select(*before, F.expr("substring(text, 1, cast(before_n div 2 as int))").alias("head"), F.col("fingerprint").alias("next_fingerprint"))
    heads = heads.groupBy(*before).agg(F.first("head").alias("head"), F.first("next_fingerprint").alias("next_fingerprint"))
    kept = placed.select(*_KEY, "id", "n", F.expr("substring(text, 1, cast(n - n div 2 as int))").alias("begin"), "fingerprint")
    edited = kept.join(heads, same("", "before_"))
    edited = edited.select("id", F.col("n").alias("n_chars"), F.concat("begin", "head").alias("edited"), "fingerprint", "next_fingerprint")
    out = fingerprinted(edited, {"edited_fingerprint": "edited"}, lists)
    return out.select(
        F.col("id").alias(id), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
