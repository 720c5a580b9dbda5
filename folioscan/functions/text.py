"""Text recognition and similarity as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of ordinary business documents.
COMMON_WORDS = (
    "a an and at by for from in of on or the to with "
    "account accounts accrual adjustment allocation amount amounts analysis balance balances bank category charge charges closing column columns "
    "code contact credit current debit deduction deductions department description detail details document due earnings email employee employees "
    "expenses fee fees floor footer grand header hours information invoice item items job known leave line lines memo message method month note notes "
    "opening outstanding overview page pay payment period permanent previous rate reason reference remarks report row rows salary schedule section "
    "service slip statement status subtotal summary support switch table tax title total totals type unit units value year"
).split()
#: Patterns of values and of colons that separate no label.
CURRENCY = [r"^\$?\s*\d{1,3}(,\d{3})*(\.\d{2})?$", r"^\d{1,3}(,\d{3})*(\.\d{2})?\s*$", r"^R\s*\d+(\.\d{2})?$", r"^€\s*\d+(\.\d{2})?$", r"^£\s*\d+(\.\d{2})?$", r"^\d+\.\d{2}$"]
NUMBER = [r"^\d+$", r"^\d{2,}[/-]\d{2,}[/-]\d{2,}$", r"^\d{10,}$", r"^[A-Z]{1,3}\d+$"]
DATE = [r"^\d{4}[/-]\d{1,2}[/-]\d{1,2}$", r"^\d{1,2}[/-]\d{1,2}[/-]\d{4}$"]
COLON_TIME, COLON_URL, COLON_RATIO = r"\d{1,2}:\d{2}(:\d{2})?", r"(?i)(https?|mailto|ftp):", r"\b\d+:\d+\b"
EXCLUDED_VALUE = [r"\d{4}[/-]\d{1,2}[/-]\d{1,2}", r"\d{1,2}[/-]\d{1,2}[/-]\d{4}", COLON_TIME, r"(?i)(https?|mailto|ftp)://"]
NUMERIC_VALUE = r"^\s*(?:[Rr]\s*)?[+\-()]*[0-9][0-9\s,.]*(?:\s*(?:Cr|Dr))?\s*$"
#: How much a value of each type weighs when it is out of line.
SUSPICION = {"currency": 2.5, "number": 2.0, "date": 1.0, "name": 3.0, "text": 1.0}


def any_like(text: Column, patterns: list[str]) -> Column:
    found = text.rlike(patterns[0])
    for p in patterns[1:]:
        found = found | text.rlike(p)
    return found


def _looks_like_name(text: Column) -> Column:
    words = F.split(text, r"\s+")
    alpha = F.filter(words, lambda w: w.rlike(r"^\p{L}+$"))
    titled = F.forall(alpha, lambda w: w.rlike(r"^\p{Lu}\p{Ll}*$"))
    return F.size(words).between(2, 5) & titled & (F.size(alpha) >= F.size(words) * 0.8)


def content_type(text: Column) -> Column:
    """currency, number, date, name or text; the first rule that fits."""
    t = F.trim(text)
    return (
        F.when(any_like(t, CURRENCY), "currency")
        .when(any_like(t, NUMBER), F.when(any_like(t, DATE), "date").otherwise("number"))
        .when(_looks_like_name(t), "name")
        .otherwise("text")
    )


def suspicion(kind: Column) -> Column:
    weight = F.lit(1.0)
    for name, w in SUSPICION.items():
        weight = F.when(kind == name, F.lit(w)).otherwise(weight)
    return weight


def is_common_phrase(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), 1)
    return (F.size(words) > 0) & F.forall(words, lambda w: w.isin(COMMON_WORDS))


def is_numeric_value(text: Column) -> Column:
    return F.coalesce(text.rlike(NUMERIC_VALUE), F.lit(False))


def is_excluded_colon(text: Column) -> Column:
    return any_like(text, [COLON_TIME, COLON_URL, COLON_RATIO])


def is_excluded_value(text: Column) -> Column:
    return any_like(text, EXCLUDED_VALUE)


def normalize(text: Column) -> Column:
    """Trimmed, lower case, white space collapsed."""
    return F.trim(F.lower(F.regexp_replace(text, r"\s+", " ")))


def normalize_clip(text: Column) -> Column:
    """No-break spaces as spaces, white space collapsed, case kept."""
    return F.trim(F.regexp_replace(F.translate(text, "\u00a0", " "), r"\s+", " "))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length; both empty 1, one empty 0."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longer)


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """Case-sensitive similarity after collapsing white space."""
    return levenshtein_similarity(normalize_clip(a), normalize_clip(b))


def _at_least(a: Column, b: Column, floor: float) -> Column:
    """levenshtein_similarity, or 0 where lengths alone say that it is below floor; equal texts aren't compared."""
    apart, longer = F.abs(F.length(a) - F.length(b)), F.greatest(F.length(a), F.length(b))
    return F.when(a == b, 1.0).when(apart > (1 - floor) * longer + 1e-9, 0.0).otherwise(levenshtein_similarity(a, b))


def token_similarity(target: Column, other: Column, phrase: bool, floor: float = 0.0) -> Column:
    """The best similarity of normalized target with other or one of its words; a phrase inside the other counts 1.

    floor: what is below may come out as 0; texts whose lengths rule it out aren't compared.
    """
    whole = _at_least(target, other, floor)
    words = F.array_max(F.transform(F.split(other, " "), lambda w: _at_least(target, w, floor)))
    best = F.when((target == other) | (F.instr(other, " ") == 0), whole).otherwise(F.greatest(whole, words))
    return F.when(other.contains(target) | target.contains(other), 1.0).otherwise(best) if phrase else best


def slugify(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_")


def font_family(name: Column) -> Column:
    """What follows the subset tag."""
    return F.element_at(F.split(name, r"\+"), -1)


def is_subset_font(name: Column) -> Column:
    return name.contains("+")


def shown_text(operator: Column, operands: Column) -> Column:
    """The text that a show operator paints: the one operand of Tj and ', the strings of TJ, the third operand of \"."""
    return F.when(operator.isin("Tj", "'"), F.get(operands, F.lit(0))).when(operator == '"', F.get(operands, F.lit(2))).when(operator == "TJ", F.array_join(F.filter(operands, lambda x: ~x.rlike(r"^-?[0-9.]+$")), ""))


#: What reports call numbers that are, and aren't, multiples of a quarter.
ROUNDING_LABELS = {"regular": "Regular size", "irregular": "Irregular size"}


def rounding_label(kind: Column) -> Column:
    """The name of a rounding class; one without a name is its own."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in ROUNDING_LABELS.items() for x in kv])[kind], kind)
