"""Markers of one class of registration documents in recognised text (I-01..I-08)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Marker texts by class.
CRITICAL = ["सूची क्र.2", "सूची क्र.२", "index-ii", "index ii", "regn:63m", "regn.63m", "regn:63", "दुय्यम निबंधक", "गावाचे नाव", "विलेखाचा प्रकार", "बाजारभाव"]
DEFINITIVE = ["सूची क्र.2", "सूची क्र.२", "index-ii", "index ii", "regn:63m", "regn.63m", "दुय्यम निबंधक"]
STRONG = ["sub-registrar class", "joint sub-registrar", "मोबदला", "भू-मापन", "पालिकेचे नाव", "हवेली"]
SUPPORTING = ["stamp duty", "registration fee", "echallan"]
HEADER = ["सूची क्र.2", "सूची क्र.२", "index-ii", "index ii", "index-2", "regn:63m", "regn.63m", "regn 63m", "regn:63", "दुय्यम निबंधक", "गावाचे नाव", "विलेखाचा प्रकार", "बाजारभाव", "सब रजिस्ट्रार", "उप निबंधक"]
NEGATIVE = [
    "no objection certificate", "no objection", "noc", "no dues certificate", "no dues", "clearance certificate", "non encumbrance", "bonafide certificate",
    "society", "co-op", "co-operative", "cooperative", "housing society", "to whomsoever", "to whom", "this is to certify", "property tax", "tax receipt",
    "deed of assignment", "assignment", "deed of transfer", "agreement", "sale agreement", "purchase agreement", "agreement to sell", "will", "testament",
    "testator", "executor", "bequeath", "bequeathed", "vendor", "purchaser", "assignor", "assignee", "transferor", "transferee", "power of attorney", "poa",
]
STRONG_NEGATIVE = [
    "no objection certificate", "no objection", "noc", "no dues certificate", "no dues", "clearance certificate", "society", "deed of assignment", "assignment",
    "agreement", "sale agreement", "purchase agreement", "agreement to sell", "will", "testament", "testator", "bequeath", "bequeathed", "vendor", "purchaser",
    "assignor", "assignee", "transferor", "transferee", "power of attorney", "poa",
]
PRINTED_KEYWORDS = ["payment", "details", "registry", "index", "सूची", "मोबदला", "regn"]
REGN = r"regn[:\s\.]*63[mM]?"


def found(text: Column, markers: list[str]) -> Column:
    """Those of the markers that the lower-case text (or, for scripts without case, the text) contains."""
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(m)) | F.contains(text, F.lit(m)), m) for m in markers]))


def early_gate(text: Column) -> Column:
    return F.length(F.trim(F.coalesce(text, F.lit("")))) < 100


def partial_header(text: Column) -> Column:
    return F.contains(text, F.lit("सूची")) & (F.contains(text, F.lit("क्र")) | F.contains(text, F.lit("2")) | F.contains(F.lower(text), F.lit("ii")))


def regn(text: Column) -> Column:
    return F.lower(text).rlike(REGN)


def distinct_letters(marker: str) -> list[str]:
    return sorted(set(marker))


_BIT = {c: 1 << i for i, c in enumerate(sorted(set("".join(NEGATIVE))))}
_MASK_BITS = len(_BIT)


def _letters(word: Column) -> Column:
    """The letters of a word that markers have, as bits; behind them its length."""
    mask = F.lit(0).cast("long")
    for c, bit in _BIT.items():
        mask = mask.bitwiseOR(F.when(F.contains(word, F.lit(c)), F.lit(bit)).otherwise(0).cast("long"))
    return F.length(word).cast("long") * (1 << _MASK_BITS) + mask


def _has(length: int, need: int, bits: int):
    """Whether a word's set is of a word that long and has that many of the letters."""
    return lambda x: (F.shiftright(x, _MASK_BITS) >= length) & (F.bit_count(x.bitwiseAND(F.lit(bits).cast("long"))) >= need)


def negatives(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``neg_exact`` and ``neg_partial`` (sorted markers).

    A marker that is not contained counts as partly found if some word is at least 0.7 of its length and has 0.8 of its distinct
    letters. Every row is judged by itself: its words become sets of letters in one long each, of which the distinct ones are held
    against the markers by counting common bits. Nothing is shuffled, so that rows may repeat an id.
    """
    # each step is a projection of its own, as its result is used many times
    df = df.withColumn("_low", F.lower(F.coalesce(F.col(text_col), F.lit(""))))
    words = F.filter(F.array_distinct(F.split(F.trim("_low"), r"\s+")), lambda w: F.length(w) >= 4)
    df = df.withColumn("_sets", F.array_distinct(F.transform(words, _letters)))
    near = []
    for m in NEGATIVE:
        if len(m) > 4:
            own = distinct_letters(m)
            length = next(n for n in range(len(m) + 1) if n >= len(m) * 0.7)
            need = next(n for n in range(len(own) + 1) if n / len(own) >= 0.8)
            near.append(F.when(F.exists("_sets", _has(length, need, sum(_BIT[c] for c in own))), m))
    exact = F.array_compact(F.array(*[F.when(F.contains(F.col("_low"), F.lit(m)), m) for m in NEGATIVE]))
    df = df.withColumns({"neg_exact": F.array_sort(exact), "_near": F.array_sort(F.array_compact(F.array(*near)))})
    return df.withColumn("neg_partial", F.array_except("_near", "neg_exact")).drop("_low", "_sets", "_near")
