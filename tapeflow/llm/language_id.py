"""Language identification by cross-parsing entropy.

For each language a suffix automaton accepts the substrings of a bounded sample of its labelled text. A text is parsed
against an automaton into phrases: from a place on, the longest match that the automaton follows, across blanks; then the
next phrase begins. The phrase count times the log of the sample's size estimates the cross entropy; the language with
the fewest normalised phrases wins.

Text and samples are reduced to lower-case letters (with the marks that belong to them) and single blanks, as figures
and signs tell no language. Every letter of a sample counts: transitions are kept in one sparse table, where a state's
row begins at a place of its own and rows interleave, so an alphabet of thousands costs as much as one of thirty. All
texts of a slice are parsed at once, one character at a time; a text of more than ``STRETCH`` characters is parsed in
stretches of that length, whose phrases add up.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeflow.llm.common import Scratch, slices

#: The sample of a language: documents and characters at most. The model takes about 1 MB for each language.
DOCS, CHARS = 60, 24_000
#: A passage: so many characters of a text, taken at any place of it.
PASSAGE = 400
STRETCH, SLICE = 4096, 1 << 20
#: States of the parser that advance together at most.
LANES = 1 << 16
#: A document of the pipeline goes if its winner's lead over the next language is below this share.
LEAST_SCORE = 0.05
UNKNOWN = "und"
_BLANK, _STRANGE = 0, 1


@cache
def kinds() -> np.ndarray:
    """Of every code point: 1 for a letter, 2 for a mark on letters, 0 for anything else."""
    return np.array([{"L": 1, "M": 2}.get(unicodedata.category(chr(i))[0], 0) for i in range(0x110000)], dtype=np.int8)


def reduced(text: str) -> str:
    """Lower-case letters and marks with single blanks between words, none at the ends."""
    return " ".join("".join(ch if unicodedata.category(ch)[0] in "LM" else " " for ch in text.lower()).split())


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of each state; state 0 is the start. Accepts every substring of ``codes``."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return step


def interleaved(rows: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(base, entries): transition c of row s is at base[s] + c, as s << 32 | target; -1 and foreign rows mean none.

    The fullest rows go first, each to the first place where its entries fall on free slots; rows of one entry fill
    what is left. ``width`` slots pad both ends, so any character of any row reads within the table.
    """
    base, size = np.full(len(rows), width, dtype=np.int32), sum(map(len, rows))
    taken = bytearray(2 * size + 5 * width)
    place, low, single = {}, width, False
    for s in sorted((s for s in range(len(rows)) if rows[s]), key=lambda s: (-len(rows[s]), s)):
        codes = sorted(rows[s])
        first, tries = codes[0], 0
        if len(codes) == 1 and not single:
            low, single = width, True
        while taken[low]:
            low += 1
        at = low
        while True:
            if not taken[at] and all(not taken[at + c - first] for c in codes[1:]):
                break
            at, tries = at + 1, tries + 1
            if tries == 64 and len(codes) > 1:
                low += 16  # crowded: what stays free here is left to rows of one entry
                tries = 0
            if at + 2 * width >= len(taken):
                taken.extend(bytearray(len(taken)))
        if len(codes) == 1:
            low = at
        for c in codes:
            taken[at + c - first] = 1
            place[at + c - first] = s << 32 | rows[s][c]
        base[s] = at - first
    lowest = int(base.min()) if len(base) else 0
    base -= lowest
    entries = np.full((max(place) if place else 0) - lowest + 2 * width + 2, -1, dtype=np.int64)
    for k, v in place.items():
        entries[k - lowest] = v
    return base, entries


class Model:
    """Languages, the code of each letter (0: blank, 1: a letter of no sample), all automata in one sparse table."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        texts = {k: f" {reduced(v)} " for k, v in samples.items()}
        self.letters = {ch: i + 2 for i, ch in enumerate(sorted({ch for t in texts.values() for ch in t} - {" "}))}
        code, width = {**self.letters, " ": _BLANK}, len(self.letters) + 2
        rows: list[dict[int, int]] = []
        self.root, self.size = [], []
        for k in self.languages:
            at = len(rows)
            rows += [{c: t + at for c, t in row.items()} for row in suffix_automaton([code[ch] for ch in texts[k]])]
            self.root.append(at)
            self.size.append(max(2, len(texts[k])))
        self.base, self.entries = interleaved(rows, width)
        self.weight = np.log2(np.array(self.size, dtype=np.float64))

    def table(self) -> np.ndarray:
        """The code of every code point."""
        out = (kinds() > 0).astype(np.int32) * _STRANGE
        for ch, c in self.letters.items():
            out[ord(ch)] = c
        return out

    def codes(self, texts: list[str | None], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of all reduced texts in a row, each between blanks; where each begins; which hold a letter."""
        low = [(t or "").lower() for t in texts]
        points = np.frombuffer("".join(f" {t} " for t in low).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        at = np.concatenate(([0], np.cumsum([len(t) + 2 for t in low])))
        code = table[points]
        kept = code != _BLANK
        kept[1:] |= code[:-1] != _BLANK
        kept[at[:-1]] = True
        before = np.concatenate(([0], np.cumsum(kept, dtype=np.int32)))
        letters = np.concatenate(([0], np.cumsum(kinds()[points] == 1, dtype=np.int32)))
        return code[kept], before[at], letters[at[1:]] > letters[at[:-1]]

    def phrases(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(texts, languages) phrase counts of texts given by ``codes``."""
        m, length = len(self.languages), np.diff(at)
        out = np.zeros((len(length), m), dtype=np.int64)
        pieces = -(-length // STRETCH)
        owner = np.repeat(np.arange(len(length)), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = at[:-1][owner] + nth * STRETCH
        size = np.minimum(STRETCH, at[1:][owner] - begin)
        order = np.argsort(-size, kind="stable")
        lanes = max(1, LANES // max(1, m))
        for a in range(0, len(order), lanes):
            some = order[a : a + lanes]
            np.add.at(out, owner[some], self._parse(codes, begin[some], size[some]).T)
        return out

    def _parse(self, codes: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """(languages, stretches) phrase counts; the stretches come longest first."""
        root = np.array(self.root, dtype=np.int64)[:, None]
        own_base = self.base[root]
        state = np.repeat(root, len(size), axis=1)
        count = np.zeros(state.shape, dtype=np.int64)
        live = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), side="left")
        for j, k in enumerate(live.tolist()):
            now = state[:, :k]
            c = codes[begin[:k] + j]
            entry = self.entries[self.base[now] + c]
            miss = (entry >> 32) != now
            entry &= 0xFFFFFFFF
            if miss.any():
                # A phrase ends before this character, unless none was open; the next begins with it, or it is one by itself.
                y, x = np.nonzero(miss)
                home = root[y, 0]
                count[y, x] += now[y, x] != home
                again = self.entries[own_base[y, 0] + c[x]]
                strange = (again >> 32) != home
                count[y, x] += strange
                entry[y, x] = np.where(strange, home, again & 0xFFFFFFFF)
            state[:, :k] = entry
        return count + (state != root)


def sample(docs: DataFrame, scratch: Scratch, learn) -> dict[str, str]:
    """A bounded sample for each language: passages at hashed places of the documents with the smallest hashes of their
    ids among those of ``learn``. Every id counts once, whatever its rows; of its texts the first in order is taken."""
    labelled = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang")
    keys = labelled.select("doc_id", "lang").withColumn("_h", F.xxhash64("doc_id", F.lit("sample")))
    counts = scratch.cut(keys.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")))
    # Of each language about four times as many ids as wanted pass by the hash alone; only those are ranked.
    share = F.least(F.lit(1.0), F.lit(4.0 * DOCS) / F.col("n"))
    few = keys.join(counts, "lang").where(F.pmod("_h", F.lit(1 << 20)) < F.greatest(share * (1 << 20), F.lit(1.0))).distinct()
    first = few.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy("_h", "doc_id"))).where(F.col("_r") <= DOCS)
    chosen = scratch.cut(first.select("doc_id", "lang", "_r"))
    # At most DOCS ids for each language: a bounded side, and one text for each of them.
    rows = labelled.join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("doc_id", "lang", "_r").agg(F.min("text").alias("text"))
    # Of each whole text the passages with the smallest hashes, as many as fill the budget; every passage counts once in
    # a language, so that a common header takes no more room than any other. Texts give theirs in turn.
    passages = F.array_distinct(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PASSAGE}}}"), F.lit(0)))
    some = F.slice(F.array_sort(F.transform(passages, lambda x: F.struct(F.xxhash64(x).alias("h"), x.alias("text")))), 1, CHARS // PASSAGE)
    each = rows.select("lang", "_r", F.posexplode(some).alias("_turn", "_p")).select("lang", "_r", "_turn", "_p.h", "_p.text")
    once = each.withColumn("_n", F.row_number().over(Window.partitionBy("lang", "h").orderBy("_turn", "_r"))).where("_n = 1")
    upto = F.sum(F.length("text") + 1).over(Window.partitionBy("lang").orderBy("_turn", "_r", "h").rowsBetween(Window.unboundedPreceding, -1))
    filled = once.withColumn("_at", F.coalesce(upto, F.lit(0))).where(F.col("_at") < CHARS)
    out: dict[str, str] = {}
    for r in filled.select("lang", "_at", "text").orderBy("lang", "_at").collect():
        out[r["lang"]] = (out.get(r["lang"], "") + " " + r["text"])[:CHARS]
    return out


def predict(docs: DataFrame, model: Model, name: str = "lang_pred", score: str = "score") -> DataFrame:
    """Adds lang_pred and score to every row; other columns stay, and columns of the added names are replaced.

    A null text, or one without a letter, gets ``und`` and 0, and so does any text if the model has no language. score:
    the share by which the winner needs fewer normalised phrases than the next language; 1 if there is no other. Ties go
    to the language first by name. Texts count in whole.
    """
    own = docs.drop(name, score)
    schema = f"{own.schema.simpleString()[7:-1]},{name}:string,{score}:double"
    shared, names = docs.sparkSession.sparkContext.broadcast(model), [*own.columns, name, score]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        table = m.table()
        for batch in slices(batches, "text", SLICE):
            codes, at, lettered = m.codes(batch.column("text").to_pylist(), table)
            entropy = m.phrases(codes, at) * m.weight
            found, sure = [], []
            for row, some in zip(entropy, lettered.tolist()):
                if not some or not len(row):
                    found.append(UNKNOWN), sure.append(0.0)
                    continue
                best = int(np.argmin(row))
                second = np.delete(row, best).min(initial=np.inf)
                found.append(m.languages[best])
                sure.append(float(1 - row[best] / second) if second > 0 else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, type=pa.string()), pa.array(sure, type=pa.float64())], names=names)

    return own.mapInArrow(run, schema)


def train(docs: DataFrame, learn) -> Model:
    """docs(doc_id, text, lang); learn: a boolean column, true for rows that may teach. Rows with a null id, text or lang don't."""
    return Model(sample(docs, Scratch(docs.sparkSession, "language-id"), learn))
