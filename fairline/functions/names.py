"""Team and player name keys, and the string similarity used on blocked candidate pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .scalars import ACCENTED, UNACCENTED, as_column, fold_ascii, indel_ratio

# Noise words and aliases of the three name keys.
TOKEN_NOISE = ("ac", "afc", "as", "cf", "fc", "calcio", "hellas")
TOKEN_ALIASES = {"estac troyes": "troyes", "stade brestois 29": "brest"}
COMPACT_NOISE = ("fc", "cf", "afc", "ac", "calcio", "club", "de", "the")
TEAM_NOISE = ("ac", "afc", "as", "borussia", "calcio", "cf", "club", "fc", "girondins", "ogc", "olympique", "sm", "stade")
TEAM_ALIASES = {"nizza": "nice", "munchen": "munich"}


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(text) for pair in pairs.items() for text in pair])


def token_key(name: Column | str, noise: Sequence[str] = TOKEN_NOISE, aliases: dict[str, str] | None = None) -> Column:
    """ASCII tokens without noise words; a run of single letters spelling one (``A. C.``) goes too."""
    words = F.array_join(F.regexp_extract_all(fold_ascii(name), F.lit("([a-z0-9]+)"), 1), " ")
    spelled = "|".join(" ".join(word) for word in sorted(noise, key=len, reverse=True))
    joined = F.regexp_replace(words, rf"(?<![a-z0-9])(?:{spelled})(?= |$)(?! [a-z0-9](?: |$))", "")
    kept = F.filter(F.split(joined, " "), lambda t: (t != "") & ~t.isin(*noise))
    key = F.array_join(kept, " ")
    table = TOKEN_ALIASES if aliases is None else aliases
    return F.coalesce(literal_map(table)[key], key) if table else key


def compact_key(name: Column | str, noise: Sequence[str] = COMPACT_NOISE) -> Column:
    """ASCII letters and digits only, noise words dropped."""
    spaced = F.regexp_replace(fold_ascii(name), rf"\b({'|'.join(noise)})\b", " ")
    return F.regexp_replace(spaced, "[^a-z0-9]", "")


def strip_accents(name: Column | str) -> Column:
    """Case-folded text without accents; letters that have no plain form stay."""
    return F.translate(F.regexp_replace(F.lower(as_column(name)), "ß", "ss"), ACCENTED, UNACCENTED)


def team_key(name: Column | str, noise: Sequence[str] = TEAM_NOISE, aliases: dict[str, str] | None = None) -> Column:
    table = literal_map(TEAM_ALIASES if aliases is None else aliases)
    tokens = F.split(F.trim(F.regexp_replace(F.regexp_replace(strip_accents(name), "'", " "), r"\s+", " ")), " ")
    kept = F.filter(tokens, lambda t: (t != "") & ~t.isin(*noise))
    return F.array_join(F.transform(kept, lambda t: F.coalesce(table[t], t)), " ")


@F.pandas_udf(T.DoubleType())
def matching_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two short names."""
    return pd.Series([SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right, strict=True)], dtype="float64")


@lru_cache(1 << 16)
def _ratio(left: str, right: str) -> float:
    """The value of ``matching_ratio``; the names of a league meet again and again."""
    return SequenceMatcher(None, left, right).ratio()


#: Pairs that are bounded at a time, and the letters that bounds tell apart: what two more have in common only raises a bound.
PAIRS, LETTERS = 1 << 18, 97
#: Bounds and scores are sums of the same fractions in another order.
ROUNDING = 1e-9


class _Letters:
    """Letter counts of the distinct names of a batch."""

    def __init__(self, names: pa.Array) -> None:
        coded = names.dictionary_encode()
        self.names, self.codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        self.sizes = np.array([len(n) for n in self.names], np.int64)
        self.letters = np.frombuffer("".join(self.names).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        letters = self.letters % LETTERS
        counts = np.bincount(letters * len(self.names) + np.repeat(np.arange(len(self.names)), self.sizes), minlength=LETTERS * len(self.names))
        counts = counts.reshape(LETTERS, -1).astype(np.uint8 if self.sizes.max(initial=0) < 256 else np.int64)
        self.counts = counts[counts.any(axis=1)]

    def most(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bound of the ratio of each pair of codes, as ``common_letters_ratio`` has it."""
        common = np.zeros(len(a), np.int64)
        for count in self.counts:
            common += np.minimum(count[a], count[b])
        total = self.sizes[a] + self.sizes[b]
        return np.where(total == 0, 1.0, 2.0 * common / np.maximum(total, 1))


class _Places(_Letters):
    """The letters of the distinct names of a batch, place by place, too."""

    #: Letters of a name that the bits of a number hold.
    WIDTH = 62

    def __init__(self, names: pa.Array) -> None:
        super().__init__(names)
        distinct, coded = np.unique(self.letters, return_inverse=True)
        # a row of places each, those behind a name hold a letter that no name has
        self.none = len(distinct)
        self.at = np.full((min(self.WIDTH, int(self.sizes.max(initial=0))), len(self.names)), self.none, np.min_scalar_type(self.none))
        name = np.repeat(np.arange(len(self.names)), self.sizes)
        place = np.arange(len(coded)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        held = place < self.WIDTH
        self.at[place[held], name[held]] = coded[held]

    def similarity(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The value of ``indel_ratio`` of each pair of codes: one step of 64-bit arithmetic per place, all pairs at a time."""
        common = np.empty(len(a), np.int64)
        long = np.maximum(self.sizes[a], self.sizes[b]) > self.WIDTH
        common[long] = [_common_subsequence(self.names[i], self.names[j]) for i, j in zip(a[long], b[long], strict=True)]
        x, y = a[~long], b[~long]
        own, row = np.unique(x, return_inverse=True)
        table = np.zeros((len(own), self.none + 1), np.uint64)
        for place, letters in enumerate(self.at):
            inside = np.flatnonzero(self.sizes[own] > place)
            table[inside, letters[own[inside]]] |= np.uint64(1 << place)
        everything = ((np.uint64(1) << self.sizes[own].astype(np.uint64)) - np.uint64(1))[row]
        held, first, table = everything, row * (self.none + 1), table.ravel()
        for letters in self.at[: self.sizes[y].max(initial=0)]:
            hit = held & table.take(first + letters.take(y))
            held = ((held + hit) | (held - hit)) & everything
        common[~long] = self.sizes[x] - np.bitwise_count(held)
        sizes = self.sizes[a] + self.sizes[b]
        return np.where(a == b, 100.0, 200.0 * common / np.maximum(sizes, 1))


def closest_pairs(met: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """(left id, right id, home_similarity, away_similarity): of all pairs of rows of ``_left`` (id, _h, _a) and ``_right`` (id, _h, _a) each left
    row's best two by the mean of two ``indel_ratio``, the lower right id first among equals.

    The two most promising by common letters are compared first, others as far as they may pass the weaker of the two."""
    types = {f: met.schema[side].dataType.elementType[f].dataType for side, f in (("_left", left_id), ("_right", right_id))}
    scores = [T.StructField(f, T.DoubleType()) for f in ("home_similarity", "away_similarity")]
    schema = T.StructType([*[T.StructField(f, kind) for f, kind in types.items()], *scores])
    kind = to_arrow_schema(schema)

    def best_two(x: np.ndarray, *order: np.ndarray) -> np.ndarray:
        """Places of the first two of each run of ``x``, by the keys of ``order``, first key first."""
        place = np.lexsort((*order[::-1], x))
        runs = x[place]
        third = np.zeros(len(x), bool)
        third[2:] = runs[2:] == runs[:-2]
        return place[~third]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (batch.column(c).flatten() for c in (0, 1))
            sizes, candidates = (batch.column(c).value_lengths().to_numpy() for c in (0, 1))
            letters = _Places(pa.concat_arrays([x.field(f) for x in (left, right) for f in ("_h", "_a")]))
            lh, la, rh, ra = np.split(letters.codes, np.cumsum([len(left), len(left), len(right)]))
            ids = right.field(right_id)
            rank = np.empty(len(ids), np.int64)
            rank[pc.array_sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
            n, begins = np.repeat(candidates, sizes), np.repeat(np.cumsum(candidates) - candidates, sizes)
            ends, row = np.cumsum(n), 0
            while row < len(n):
                last = max(row + 1, int(np.searchsorted(ends, ends[row] - n[row] + PAIRS, "right")))
                own = n[row:last]
                x = np.repeat(np.arange(row, last), own)
                y = np.arange(len(x)) - np.repeat(np.cumsum(own) - own, own) + begins[x]
                home, away = 100.0 * letters.most(lh[x], rh[y]), 100.0 * letters.most(la[x], ra[y])
                first = best_two(x, -(home + away))
                home[first], away[first] = letters.similarity(lh[x[first]], rh[y[first]]), letters.similarity(la[x[first]], ra[y[first]])
                weaker = np.full(last - row, np.inf)
                np.minimum.at(weaker, x[first] - row, home[first] + away[first])
                done = np.zeros(len(x), bool)
                done[first] = True
                may = lambda: ~done & (home + away >= weaker[x - row] - 2 * ROUNDING)  # noqa: B023, E731
                rest = np.flatnonzero(may())
                home[rest] = letters.similarity(lh[x[rest]], rh[y[rest]])
                rest = rest[may()[rest]]
                away[rest] = letters.similarity(la[x[rest]], ra[y[rest]])
                done[rest] = True
                x, y, home, away = x[done], y[done], home[done], away[done]
                kept = best_two(x, -(home + away) / 2, rank[y])
                yield pa.RecordBatch.from_arrays([
                    left.field(left_id).take(pa.array(x[kept])).cast(kind[0].type), ids.take(pa.array(y[kept])).cast(kind[1].type), pa.array(home[kept]), pa.array(away[kept])], schema=kind)
                row = last

    return met.mapInArrow(run, schema)


def likely_pairs(met: DataFrame, left_id: str, right_id: str, threshold: float, gap: float) -> DataFrame:
    """(left id, right id, score): of all pairs of rows of ``_left`` (id, _once, _h, _a) and ``_right`` (id, _h, _a), those whose sum of two
    ``matching_ratio`` may be the best of the left id from ``threshold`` up, or lies less than ``gap`` below one.

    ``_once`` tells that the left id has no other row anywhere, so that without an answer here it has none."""
    types = {f: met.schema[side].dataType.elementType[f].dataType for side, f in (("_left", left_id), ("_right", right_id))}
    schema = T.StructType([*[T.StructField(f, kind) for f, kind in types.items()], T.StructField("score", T.DoubleType())])
    kind, least, reach = to_arrow_schema(schema), threshold - gap, max(gap, 0.0)

    def best(once: bool, home: list, away: list, home_most: list, away_most: list) -> Iterator[tuple[int, float]]:
        """(place, score) of one left row's pairs, which come in falling order of their bounds."""
        top, found = float("-inf"), []
        for at, (h, a, hm, am) in enumerate(zip(home, away, home_most, away_most, strict=True)):
            cut = max(least, top - reach) - ROUNDING
            if hm + am < cut or (once and top < threshold and hm + am < threshold - ROUNDING):
                break
            score = _ratio(*h)
            if score + am < cut:
                continue
            score += _ratio(*a)
            top = max(top, score)
            found.append((at, score))
        return ((at, score) for at, score in found if score >= top - reach - ROUNDING and not (once and top < threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (batch.column(c).flatten() for c in (0, 1))
            sizes, candidates = (batch.column(c).value_lengths().to_numpy() for c in (0, 1))
            letters = _Places(pa.concat_arrays([x.field(f) for x in (left, right) for f in ("_h", "_a")]))
            names, codes = letters.names, np.split(letters.codes, np.cumsum([len(left), len(left), len(right)]))
            once = left.field("_once").to_numpy(zero_copy_only=False)
            n, begins = np.repeat(candidates, sizes), np.repeat(np.cumsum(candidates) - candidates, sizes)
            ends, row = np.cumsum(n), 0
            while row < len(n):
                last = max(row + 1, int(np.searchsorted(ends, ends[row] - n[row] + PAIRS, "right")))
                own = n[row:last]
                x = np.repeat(np.arange(row, last), own)
                y = np.arange(len(x)) - np.repeat(np.cumsum(own) - own, own) + begins[x]
                home, away = letters.most(codes[0][x], codes[2][y]), letters.most(codes[1][x], codes[3][y])
                # what matches in order is a common subsequence, so the longest one bounds a ratio closer than letters do
                kept = np.flatnonzero(home + away >= least - ROUNDING)
                for k, most in enumerate((home, away)):
                    most[kept] = letters.similarity(codes[k][x[kept]], codes[k + 2][y[kept]]) / 100.0
                    kept = kept[home[kept] + away[kept] >= least - ROUNDING]
                kept = kept[np.lexsort((-(home + away)[kept], x[kept]))]
                x, y, home, away = x[kept], y[kept], home[kept], away[kept]
                at, scores = [], []
                for i, j in zip(b := np.flatnonzero(np.diff(x, prepend=-1)), [*b[1:], len(x)], strict=True):
                    pairs = [[(names[p], names[q]) for p, q in zip(codes[k][x[i:j]], codes[k + 2][y[i:j]], strict=True)] for k in (0, 1)]
                    for place, score in best(once[x[i]], *pairs, home[i:j].tolist(), away[i:j].tolist()):
                        at.append(i + place)
                        scores.append(score)
                if at:
                    yield pa.RecordBatch.from_arrays([
                        left.field(left_id).take(pa.array(x[at])).cast(kind[0].type), right.field(right_id).take(pa.array(y[at])).cast(kind[1].type), pa.array(scores, pa.float64())], schema=kind)
                row = last

    return met.mapInArrow(run, schema)


def once_a_row(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is made once a row; inside a lambda an expression is made again for every element."""
    return F.transform(F.array(value), use)[0]


def letter_tokens(name: Column | str) -> Column:
    """Each letter with the number of its occurrence so far, so that arrays of tokens meet as multisets of letters."""
    letters = F.filter(F.split(as_column(name), ""), lambda x: x != "")
    return once_a_row(letters, lambda held: F.transform(
        held, lambda x, i: F.concat(x, F.size(F.filter(F.slice(held, 1, i + 1), lambda y: y == x)).cast("string"))))


def common_letters_ratio(left_tokens: Column | str, right_tokens: Column | str) -> Column:
    """2 * common letters / all letters, from ``letter_tokens``: never below ``matching_ratio`` nor a hundredth of ``indel_ratio``."""
    a, b = as_column(left_tokens), as_column(right_tokens)
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / total)


def letter_places(name: Column | str) -> Column:
    """Map from each of the first 62 letters of a name to the bits of its places."""
    letters = F.filter(F.split(F.substring(as_column(name), 1, 62), ""), lambda x: x != "")
    place = lambda held, x: F.transform(held, lambda y, i: F.when(y == x, F.pow(F.lit(2.0), i).cast("long")).otherwise(F.lit(0).cast("long")))
    bits = lambda held, x: F.aggregate(place(held, x), F.lit(0).cast("long"), lambda total, bit: total + bit)
    entries = once_a_row(letters, lambda held: F.transform(F.array_distinct(held), lambda x: F.struct(x.alias("letter"), bits(held, x).alias("places"))))
    return F.when(F.size(letters) == 0, F.expr("cast(map() as map<string, bigint>)")).otherwise(F.map_from_entries(entries))


def indel_by_places(left: Column | str, places: Column | str, right: Column | str) -> Column:
    """The value of ``indel_ratio``, one step of 64-bit arithmetic per letter of ``right``; ``places`` is ``letter_places(left)``.

    A left name over 62 letters goes through ``indel_ratio`` itself."""
    a, b, table = as_column(left), as_column(right), as_column(places)
    everything = F.pow(F.lit(2.0), F.length(a)).cast("long") - 1

    def step(held: Column, letter: Column) -> Column:
        hit = held.bitwiseAND(F.coalesce(F.try_element_at(table, letter), F.lit(0)))
        return (held + hit).bitwiseOR(held - hit).bitwiseAND(everything)

    common = F.length(a) - F.bit_count(F.aggregate(F.split(b, ""), everything, step))
    scored = F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(200.0 * common / (F.length(a) + F.length(b)))
    return F.when(a == b, F.lit(100.0)).when(F.length(a) > 62, indel_ratio(a, b)).otherwise(scored)


def _common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine-word step per letter of ``b``."""
    places: dict[str, int] = {}
    for i, letter in enumerate(a):
        places[letter] = places.get(letter, 0) | (1 << i)
    everything = (1 << len(a)) - 1
    open_bits = everything
    for letter in b:
        hit = open_bits & places.get(letter, 0)
        open_bits = ((open_bits + hit) | (open_bits - hit)) & everything
    return len(a) - open_bits.bit_count()


@F.pandas_udf(T.DoubleType())
def indel_similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    """200 * LCS / (len a + len b).  Same values as the ``indel_ratio`` expression, about fifty
    times faster per pair on names of twenty letters (measured)."""
    scores = [
        100.0 if a == b else 200.0 * _common_subsequence(a, b) / (len(a) + len(b)) if a and b else 0.0 for a, b in zip(left, right, strict=True)
    ]
    return pd.Series(scores, dtype="float64")
