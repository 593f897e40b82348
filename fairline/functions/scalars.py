"""Column expressions shared by the operators.  Everything stays inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

OUTCOMES = ("H", "D", "A")
PROBABILITY_FLOOR = 1e-15

# Latin letters whose decomposition starts with an ASCII letter.
ACCENTED = "áàâäãåāăąçćčďéèêëēėęěíìîïīįľĺñńňóòôöõōőŕřśšşșťţțúùûüūůűýÿźžżğ"
UNACCENTED = "aaaaaaaaacccdeeeeeeeeiiiiiillnnnooooooorrsssstttuuuuuuuyyzzzg"


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def number_or_null(value: Column | str) -> Column:
    """Tolerant cast to double; NaN and infinities become NULL."""
    text = as_column(value).cast("string")
    parsed = text.try_cast("double")
    return finite(parsed)


def int_or_null(value: Column | str) -> Column:
    """Tolerant cast of counters and shirt numbers such as ``'7'`` or ``'7.0'``."""
    return number_or_null(value).try_cast("int")


def finite(value: Column | str) -> Column:
    """NaN and infinities become NULL (NaN sorts above every number, so one comparison does)."""
    column = as_column(value)
    return F.when(F.abs(column) < float("inf"), column)


def safe_ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """n/d, NULL where the denominator is NULL, zero or negative."""
    below = as_column(denominator)
    return F.when(below > 0, as_column(numerator).cast("double") / below)


def clip(value: Column | str, low: float, high: float) -> Column:
    return F.least(F.greatest(as_column(value), F.lit(low)), F.lit(high))


def round6(value: Column | str) -> Column:
    return F.round(as_column(value), 6)


def overround(*prices: Column | str) -> Column:
    """Sum of inverse prices, added in wide form so every engine sums in the same order."""
    terms = [F.try_divide(F.lit(1.0), as_column(price)) for price in prices]
    return reduce(lambda left, right: left + right, terms)


def fair_probability(price: Column | str, total: Column | str) -> Column:
    return F.try_divide(F.try_divide(F.lit(1.0), as_column(price)), as_column(total))


def argmax_label(values: Sequence[Column | str], labels: Sequence[str] = OUTCOMES) -> Column:
    """Label of the largest value; the first label wins a tie."""
    columns = [as_column(value) for value in values]
    place = F.array_position(F.array(*columns), F.greatest(*columns)).cast("int")
    return F.get(F.array(*[F.lit(label) for label in labels]), place - 1)


def pick(label: Column | str, values: dict[str, Column | str]) -> Column:
    """Value belonging to ``label``; NULL for any other label."""
    place = F.array_position(F.array(*[F.lit(key) for key in values]), as_column(label)).cast("int")
    return F.get(F.array(*[as_column(value) for value in values.values()]), place - 1)


def log_loss_row(label: Column | str, values: dict[str, Column | str]) -> Column:
    probability = pick(label, values)
    return -F.ln(clip(probability, PROBABILITY_FLOOR, 1.0))


def brier_row(label: Column | str, values: dict[str, Column | str]) -> Column:
    truth = as_column(label)
    terms = [F.pow(as_column(p) - (truth == key).cast("double"), 2) for key, p in values.items()]
    return reduce(lambda left, right: left + right, terms)


def rps_row(label: Column | str, values: dict[str, Column | str]) -> Column:
    """Ranked probability score over the ordered outcomes."""
    truth = as_column(label)
    error, total = F.lit(0.0), F.lit(0.0)
    for key, probability in list(values.items())[:-1]:
        error = error + as_column(probability) - (truth == key).cast("double")
        total = total + F.pow(error, 2)
    return total / 2.0


def arange_edges(width: float) -> list[float]:
    """0, w, 2w, ... , 1 with the same floating-point steps numpy's arange makes."""
    if not 0 < width <= 1:
        raise ValueError("bin width must lie in (0, 1]")
    edges, step = [], 0
    while step * width < 1.0:
        edges.append(step * width)
        step += 1
    return sorted({*edges, 1.0})


def interval_labels(edges: Sequence[float], right: bool = True) -> list[str]:
    def text(edge: float) -> str:
        shown = round(edge, 3)
        return f"{shown:.1f}" if shown == int(shown) else f"{shown:g}"

    labels = []
    for position, (low, high) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        left = text(low - 0.001) if right and position == 0 else text(low)
        labels.append(f"({left}, {text(high)}]" if right else f"[{left}, {text(high)})")
    return labels


def cut(
    value: Column | str,
    edges: Sequence[float],
    labels: Sequence[object] | None = None,
    right: bool = True,
) -> Column:
    """Label of the interval holding ``value``: right-closed with the lowest edge included,
    or left-closed when ``right`` is false.  Values outside every interval give NULL."""
    column = as_column(value)
    names = list(labels) if labels is not None else interval_labels(edges, right)
    if len(names) != len(edges) - 1:
        raise ValueError("one label per interval is required")
    result = None
    for position, (low, high) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if right:
            lower = column >= low if position == 0 else column > low
            inside = lower & (column <= high)
        else:
            inside = (column >= low) & (column < high)
        label = F.lit(names[position])
        result = F.when(inside, label) if result is None else result.when(inside, label)
    return result


def fold_ascii(value: Column | str) -> Column:
    """Lower-case, strip accents of Latin letters and drop what is left outside ASCII."""
    lowered = F.lower(as_column(value))
    folded = F.translate(lowered, ACCENTED, UNACCENTED)
    return F.regexp_replace(folded, r"[^\x00-\x7F]", "")


def collapse_spaces(value: Column | str) -> Column:
    return F.trim(F.regexp_replace(as_column(value), r"\s+", " "))


def utc_micros(value: Column | str) -> Column:
    """Instant as a long; text with an offset and naive UTC text compare equal."""
    return F.unix_micros(F.try_to_timestamp(as_column(value)))


def season_start(value: Column | str) -> Column:
    """First calendar year of a season written ``2010/11`` or ``1011`` (pivot 1950)."""
    text = as_column(value).cast("string")
    first = F.substring(text, 1, 2).try_cast("int")
    return F.when(text.rlike(r"^\d{4}/\d{2}$"), F.substring(text, 1, 4).try_cast("int")).when(
        text.rlike(r"^\d{4}$"), first + F.when(first >= 50, 1900).otherwise(2000)
    )


def season_code(year: Column | str) -> Column:
    """``2018`` gives ``1819``."""
    start = as_column(year).cast("int")
    return F.concat(
        F.lpad((start % 100).cast("string"), 2, "0"), F.lpad(((start + 1) % 100).cast("string"), 2, "0")
    )


def season_code_from_range(value: Column | str) -> Column:
    """``2010/2011`` gives ``1011``."""
    return F.concat(
        F.regexp_extract(as_column(value), r"^\d{2}(\d{2})/\d{2}(\d{2})$", 1),
        F.regexp_extract(as_column(value), r"^\d{2}(\d{2})/\d{2}(\d{2})$", 2),
    )


def uuid_from_name(namespace_hex: str, name: Column | str) -> Column:
    """Name-based (version 5) identifier built from SHA-1."""
    payload = F.concat(F.unhex(F.lit(namespace_hex)), F.encode(as_column(name), "UTF-8"))
    digest = F.sha1(payload)
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3),
        F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12),
    )


def natural_key_id(*parts: Column | str) -> Column:
    """First 24 hex digits of SHA-256 over the pipe-joined parts."""
    joined = F.concat_ws("|", *[as_column(part).cast("string") for part in parts])
    return F.substring(F.sha2(joined, 256), 1, 24)


def binary_entropy(probability: Column | str) -> Column:
    p = as_column(probability)
    inside = -(p * F.ln(p) + (1 - p) * F.ln(1 - p)) / F.ln(F.lit(2.0))
    return F.when((p > 0) & (p < 1), inside).otherwise(0.0)


def indel_ratio(left: Column | str, right: Column | str) -> Column:
    """200 * LCS / (len a + len b), by a row-by-row longest-common-subsequence fold."""
    a, b = as_column(left), as_column(right)
    chars_a, chars_b = F.split(a, ""), F.split(b, "")
    start = F.transform(F.sequence(F.lit(0), F.length(b)), lambda _: F.lit(0))

    def next_row(row: Column, letter: Column) -> Column:
        first = F.array(F.lit(0))
        return F.aggregate(
            F.sequence(F.lit(1), F.length(b)),
            first,
            lambda built, j: F.concat(
                built,
                F.array(
                    F.when(F.element_at(chars_b, j) == letter, F.element_at(row, j) + 1).otherwise(
                        F.greatest(F.element_at(row, j + 1), F.element_at(built, -1))
                    )
                ),
            ),
        )

    longest = F.element_at(F.aggregate(chars_a, start, next_row), -1)
    total = F.length(a) + F.length(b)
    scored = F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(200.0 * longest / total)
    return F.when(a == b, F.lit(100.0)).otherwise(scored)
