"""Language identification by hyperdimensional n-gram profiles.

Every letter has a fixed random vector of +1 and -1, drawn from its code point.  An
n-gram binds its letters' vectors, each rotated by its place, into one product; a text
bundles (adds) the vectors of its n-grams; a language prototype bundles the texts of
its training rows; a text gets the language whose prototype has the largest cosine.
Texts are lower-cased; a run of other characters counts as one word boundary, which
has a vector of its own.

Work per text follows its length: n-grams are counted over a compact code of the
letters that occur in a piece of text, and the counts meet the n-gram vectors in one
matrix product per group of texts.  Training emits one integer vector per task and
language, which Spark adds up by (language, component), so every training row counts
and the sums do not depend on task order; the driver sees languages x dimensions
numbers, however large the corpus is.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; without any
training row every text is; ties go to the language that sorts first; rows with null
lang do not train; a null id counts as empty text in the split; repeated rows are
judged (and train) as often as they occur; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomcast.llm.frames import bounded_rows, rows_out

UND = "und"
#: Code points of one piece, and bytes of text of one matrix product.
PIECE = 1 << 20
GROUP_BYTES = 1 << 20
#: Up to so many letter combinations are counted by direct address, more by sorting.
DIRECT = 1 << 22


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    table[[c for c in range(0x110000) if chr(c).isalpha()]] = True
    return table


@lru_cache(maxsize=4096)
def letter_vector(code: int, dims: int) -> np.ndarray:
    bits = np.random.Generator(np.random.PCG64([20240301, code])).integers(0, 2, dims)
    return (2 * bits - 1).astype(np.float32)


def letter_codes(text: str) -> np.ndarray:
    """Code points of the letters, 0 for each run of other characters, 0 at both ends; empty without letters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return np.zeros(0, np.uint32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    kept = np.where(letter, codes, 0)[keep]
    lead = [] if kept[0] == 0 else [np.zeros(1, kept.dtype)]
    trail = [] if kept[-1] == 0 else [np.zeros(1, kept.dtype)]
    return np.concatenate([*lead, kept, *trail])


def _pieces(texts: list[str | None], n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(text number, codes); long texts in pieces that overlap by n - 1 codes."""
    for i, text in enumerate(texts):
        codes = letter_codes(text or "")
        for lo in range(0, max(len(codes) - n + 1, 0), PIECE):
            yield i, codes[lo : lo + PIECE + n - 1]


def bundle(texts: list[str | None], dims: int, n: int) -> np.ndarray:
    """Vector of each text (float64, whole numbers); zeros for texts without letters."""
    out = np.zeros((len(texts), dims))
    group: list[tuple[int, np.ndarray]] = []
    held = 0

    def flush() -> None:
        if group:
            _bundle_group(group, dims, n, out)
            group.clear()

    for i, codes in _pieces(texts, n):
        group.append((i, codes))
        held += len(codes)
        if held >= PIECE:
            flush()
            held = 0
    flush()
    return out


def _bundle_group(group: list[tuple[int, np.ndarray]], dims: int, n: int, out: np.ndarray) -> None:
    every = np.concatenate([codes for _, codes in group])
    seen = np.zeros(int(every.max()) + 1, bool)
    seen[every] = True
    alphabet = np.flatnonzero(seen)
    place = np.zeros(len(seen), np.int64)
    place[alphabet] = np.arange(len(alphabet))
    compact, base = place[every], len(alphabet)
    # n-gram number at every position; the ones that run over the end of a piece are not used
    combo = np.zeros(len(compact) - n + 1, np.int64)
    for j in range(n):
        combo = combo * base + compact[j : j + len(combo)]
    ends = np.cumsum([len(codes) for _, codes in group])
    if base**n <= DIRECT:
        there = np.zeros(base**n, bool)
        there[combo] = True
        grams = np.flatnonzero(there)
        number = np.zeros(base**n, np.int32)
        number[grams] = np.arange(len(grams))
        numbered = number[combo]
    else:
        grams, numbered = np.unique(combo, return_inverse=True)
    table = np.stack([letter_vector(int(c), dims) for c in alphabet])
    vectors, rest = np.ones((len(grams), dims), np.float32), grams
    for j in range(n):  # the last letter is not rotated, the one before by one place, and so on
        rest, last = np.divmod(rest, base)
        vectors *= np.roll(table, j, axis=1)[last]
    step = max(1, (16 << 20) // (4 * len(grams)))
    for lo in range(0, len(group), step):
        part = group[lo : lo + step]
        counts = np.zeros((len(part), len(grams)), np.float32)
        for row, (_, codes) in enumerate(part):
            end = ends[lo + row]
            counts[row] = np.bincount(numbered[end - len(codes) : end - n + 1], minlength=len(grams))
        np.add.at(out, [i for i, _ in part], counts @ vectors)


def held_out(id_col: str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts == part


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang", dims: int = 512, n: int = 3) -> dict[str, np.ndarray]:
    """Prototype (unit length) of every non-null lang value with a letter in its texts."""
    rows = df.filter(F.col(lang_col).isNotNull()).select(
        F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")
    )
    schema = pa.schema([("lang", pa.string()), ("i", pa.int32()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in bounded_rows(batch, "text", GROUP_BYTES):
                vectors = bundle(part.column("text").to_pylist(), dims, n)
                langs = np.array(part.column("lang").to_pylist(), object)
                for lang in dict.fromkeys(langs):
                    sums[lang] = sums.get(lang, 0) + vectors[langs == lang].sum(axis=0)
        for lang, v in sums.items():
            yield rows_out(schema, [[lang] * dims, np.arange(dims, dtype=np.int32), np.rint(v).astype(np.int64)])

    totals = rows.mapInArrow(run, "lang string, i int, v long").groupBy("lang", "i").agg(F.sum("v").alias("v"))
    found: dict[str, np.ndarray] = {}
    for r in totals.collect():  # languages x dims numbers
        found.setdefault(r["lang"], np.zeros(dims))[r["i"]] = r["v"]
    return {lang: v / np.linalg.norm(v) for lang, v in sorted(found.items()) if v.any()}


def predict(
    df: DataFrame,
    prototypes: dict[str, np.ndarray],
    n: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """(id, carried columns, lang_pred, score) of every row; score is the cosine, 0 if it is negative."""
    langs = sorted(prototypes)
    matrix = np.stack([prototypes[x] for x in langs]) if langs else np.zeros((0, 1))
    kept = df.select(F.col(id_col), *carry, F.col(text_col).cast("string").alias("__text"))
    fields = [f for f in kept.schema.fields if f.name != "__text"]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded_rows(batch, "__text", GROUP_BYTES):
                names = [UND] * part.num_rows
                scores = np.zeros(part.num_rows)
                if langs:
                    vectors = bundle(part.column("__text").to_pylist(), matrix.shape[1], n)
                    norms = np.linalg.norm(vectors, axis=1)
                    cosines = vectors @ matrix.T / np.where(norms > 0, norms, 1)[:, None]
                    best = cosines.argmax(axis=1)
                    names = [langs[b] if x > 0 else UND for b, x in zip(best, norms)]
                    scores = np.where(norms > 0, np.clip(cosines.max(axis=1), 0.0, 1.0), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                    names=[f.name for f in fields] + ["lang_pred", "score"],
                )

    return kept.mapInArrow(run, ddl)
