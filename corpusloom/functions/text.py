"""Text functions as Catalyst expressions: tokens, names, folding, previews."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no tokens.
STOP_WORDS = (
    "a an and as at are be been become by for from if in into is it its of or so such than that the this to through under using "
    "use via was were we with without you your they their them there when where who which why how also have has had will would "
    "should could must can may might mustn't not no yes"
).split()
# Endings of Korean words in the order in which they are tried.
KOREAN_ENDINGS = (
    "으로부터 에서부터 에게서는 에게서 입니다 합니다 했습니다 됩니다 되면서 되었다 되었던 되었다가 되는 된다 되고 했다 했던 하고 하며 하면 하여 해서 하는 하다 "
    "처럼 보다 부터 까지 으로 에서 에게 한테 께서 께는 께도 께 이고 이며 이라 로는 로도 와 과 을 를 이 가 은 는 에 도 만 의 로"
).split()
STEM_WEIGHT, COMPOUND_WEIGHT = 0.78, 0.52
# A run of letters, digits and ``_`` without outer ``_``, longer than one character.
WORD = r"[\p{L}\p{N}][\p{L}\p{N}_]*[\p{L}\p{N}]"
HANGUL = r"[\x{AC00}-\x{D7A3}]"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and ``_`` without outer ``_``, longer than
    one character, that are no stop words; in order, with repeats."""
    raw = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
    # a token named like an inherited property of the source's word table is dropped as well
    return F.filter(raw, lambda t: ~t.isin([*STOP_WORDS, "constructor"]))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with value computed once and written once into the plan."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def korean_forms(token: Column) -> Column:
    """Derived forms of one token: array of (token, weight); empty unless Hangul."""
    form = lambda t, w: F.struct(t.alias("token"), F.lit(w).alias("weight"))
    none = F.array().cast("array<struct<token:string,weight:double>>")
    endings = F.array(*[F.lit(e) for e in KOREAN_ENDINGS])

    def stem_of(t: Column) -> Column:
        # the first ending in order that leaves two characters or more
        fitting = F.get(F.filter(endings, lambda e: t.endswith(e) & (F.char_length(t) - F.char_length(e) >= 2)), F.lit(0))
        return F.substring(t, F.lit(1), F.char_length(t) - F.char_length(fitting))

    def halves(root: Column) -> Column:
        n = F.char_length(root)
        cuts = F.filter(F.when(n >= 4, F.sequence(F.lit(2), n - 2)).otherwise(F.array().cast("array<int>")), lambda i: (i <= 4) & (n - i <= 4) & (F.abs(2 * i - n) <= 2))
        return F.array_distinct(F.flatten(F.transform(cuts, lambda i: F.array(form(F.substring(root, F.lit(1), i), COMPOUND_WEIGHT), form(F.substring(root, i + 1, n - i), COMPOUND_WEIGHT)))))

    def forms(stem: Column) -> Column:
        parts = let(F.coalesce(stem, token), halves)
        # a form that is found twice keeps its higher weight, which stands first
        return F.when(stem.isNull(), parts).otherwise(F.concat(F.array(form(stem, STEM_WEIGHT)), F.filter(parts, lambda p: p["token"] != stem)))

    return F.when(token.rlike(HANGUL) & (F.char_length(token) >= 2), let(stem_of(token), forms)).otherwise(none)


def document_tokens(text: Column) -> Column:
    """Tokens of a document field: base tokens with repeats, then derived forms that
    are no base tokens, each once."""

    def all_of(base: Column) -> Column:
        hangul = F.filter(base, lambda t: t.rlike(HANGUL))
        derived = F.flatten(F.transform(hangul, lambda t: F.transform(korean_forms(t), lambda f: f["token"])))
        # most texts have no Hangul, which is seen without looking at each token
        return F.when(~F.coalesce(text, F.lit("")).rlike(HANGUL), base).when(F.size(hangul) == 0, base).otherwise(F.concat(base, F.array_except(F.array_distinct(derived), base)))

    return let(tokens(text), all_of)


@lru_cache(maxsize=1)
def folding() -> tuple[str, str]:
    """Letters with one diacritic and the plain letters an index keeps for them
    (by rule: canonical decomposition to one ASCII letter and one mark)."""
    found, plain = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) == 2 and parts[0].isascii() and unicodedata.combining(parts[1]):
            found.append(chr(code))
            plain.append(parts[0].lower())
    return "".join(found), "".join(plain)


def folded(text: Column) -> Column:
    """Text as the index stores it: Latin letters without their diacritics."""
    # as many bytes as characters: ASCII
    return F.when(F.octet_length(text) == F.char_length(text), text).otherwise(F.translate(text, *folding()))


def canonical_name(name: Column) -> Column:
    """Trimmed, without ``.md`` and a leading ``skill-``, blanks to dashes, lower case."""
    plain = F.regexp_replace(F.btrim(name), r"(?i)\.md$", "")
    plain = F.regexp_replace(plain, r"(?i)^skill[-_]", "")
    return F.lower(F.regexp_replace(plain, r"\s+", "-"))


def preview(text: Column, chars: int) -> Column:
    return F.regexp_replace(F.substring(F.coalesce(text, F.lit("")), 1, chars), "\n+", " ")


def read_path(name: Column, prefix: str = "skill://") -> Column:
    return F.concat(F.lit(prefix), name)


def similarity(left: Column, right: Column, longest: int = 256) -> Column:
    """1 less the edit distance over the longer length; 0 for overlong inputs."""
    most = F.greatest(F.char_length(left), F.char_length(right))
    return F.when(most > longest, F.lit(0.0)).when(most == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(left, right) / most)


def osa(left: str, right: str, most: int) -> int | None:
    """Edit distance with neighbour swaps (optimal string alignment) of 1 to ``most``, else None."""
    if abs(len(left) - len(right)) > most:
        return None
    older: list[int] = []
    row = list(range(len(right) + 1))
    for i, a in enumerate(left, 1):
        line = [i]
        for j, b in enumerate(right, 1):
            best = min(row[j] + 1, line[j - 1] + 1, row[j - 1] + (a != b))
            if i > 1 and j > 1 and a == right[j - 2] and left[i - 2] == b:
                best = min(best, older[j - 2] + 1)
            line.append(best)
        if min(line) > most:
            return None
        older, row = row, line
    return row[-1] if 0 < row[-1] <= most else None


def osa_column(left: Column, right: Column, most: Column) -> Column:
    """:func:`osa` over columns (Arrow batches; used on blocked candidates only)."""

    @F.pandas_udf("int")
    def run(a: pd.Series, b: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([osa(x, y, z) for x, y, z in zip(a, b, m, strict=True)], dtype="Int32")

    return run(left, right, most)


def fixed3(value: float) -> float:
    """Three decimals of the exact binary value, ties away from zero."""
    return float(Decimal(value).quantize(Decimal("0.001"), ROUND_HALF_UP))


def fixed3_column(value: Column) -> Column:
    """:func:`fixed3` over a column; for few rows (candidates), where exact ties matter."""

    @F.pandas_udf("double")
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if pd.isna(x) else fixed3(x)).astype("float64")

    return run(value)


def locale_order(column: Column) -> Column:
    """Sort key of language-aware order."""
    return F.collate(column, "UNICODE")
