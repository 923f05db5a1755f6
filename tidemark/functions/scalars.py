"""Small column expressions: hashes for stable orders, statistics, lenient reading."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_key(*parts: Column) -> Column:
    """SHA-256 of the parts joined by '|': an order that no partition changes."""
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def tie_hash(*parts: Column) -> Column:
    """First eight bytes of the key as an unsigned number."""
    return F.conv(F.substring(hash_key(*parts), 1, 16), 16, 10).cast("decimal(20,0)")


def wilson(successes: Column, total: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Lower and upper end of the binomial interval; (0, 1) without trials."""
    n, p = total.cast("double"), successes / total
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(total > 0, F.greatest(middle - half, F.lit(0.0))).otherwise(0.0), F.when(total > 0, F.least(middle + half, F.lit(1.0))).otherwise(1.0)


def ratio(a: Column, b: Column) -> Column:
    """Null where the denominator is 0."""
    return F.when(b != 0, a / b)


def lenient_double(text: Column) -> Column:
    """Null for anything that is no number."""
    return text.try_cast("double")


def parse_rate(text: Column) -> Column:
    """'30000/1001' or '25' as a decimal; null for a zero denominator or anything else."""
    num = F.regexp_extract(text, r"^(\d+)(?:/(\d+))?$", 1)
    den = F.regexp_extract(text, r"^(\d+)(?:/(\d+))?$", 2)
    d = F.when(den == "", "1").otherwise(den).try_cast("decimal(18,6)")
    return F.when((num != "") & (d > 0), num.try_cast("decimal(18,6)") / d).cast("decimal(24,12)")


def bucket_label(value: Column, bounds: list[float]) -> Column:
    """Half-open bucket '[a,b)' of a value, 'unknown' for null."""
    edges = [float("-inf"), *bounds, float("inf")]
    out = F.when(value.isNull(), "unknown")
    for a, b in zip(edges, edges[1:], strict=False):
        out = out.when(value < b, f"[{a:g},{b:g})") if b != float("inf") else out.otherwise(f"[{a:g},{b:g})")
    return out


def ln(x: Column) -> Column:
    """Natural logarithm as floating point has it: -inf of 0 and NaN of less, where Spark's is null."""
    return F.when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan"))).otherwise(F.ln(x))


def log_loss(p: Column, y: Column, eps: float = 1e-7) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return -(y * F.ln(q) + (1 - y) * F.ln(1 - q))


def log_loss_of_logit(z: Column, y: Column) -> Column:
    return F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def canonical_json(**fields: Column) -> Column:
    """JSON text with keys in order, no blanks, one form for zero; an error for NaN and infinities, which JSON has not. Nulls stay as null."""

    def text(c: Column) -> Column:
        number = c.try_cast("double")
        bad = number.isNotNull() & (F.isnan(number) | (F.abs(number) == float("inf"))) & (F.typeof(c).isin("double", "float"))
        whole = F.when(F.typeof(c).isin("double", "float") & (number == 0), F.lit("0.0")).otherwise(F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", ""))
        return F.when(bad, F.raise_error(F.lit("not a JSON number")).cast("string")).otherwise(whole)

    parts = [F.concat(F.lit(f'"{k}":'), text(c)) for k, c in sorted(fields.items())]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def first_match(text: Column, rules: list[tuple[str, str]], otherwise: str) -> Column:
    """Class of the first pattern that the text holds; ``otherwise`` for none and for null."""
    out = F.when(text.isNull(), otherwise)
    for pattern, name in rules:
        out = out.when(text.rlike(pattern), name)
    return out.otherwise(otherwise)


def read_intervals(text: Column) -> Column:
    """'3-5; 7-9' as an array of (a, b); null ends where a part is no pair of whole numbers."""
    part = lambda x, k: F.regexp_extract(F.trim(x), r"^(\d+)-(\d+)$", k).try_cast("int")
    return F.transform(F.split(text, ";"), lambda x: F.struct(part(x, 1).alias("a"), part(x, 2).alias("b")))
