"""Language spans: script ranges, then Viterbi over per-word scores.

Words are runs of letters, longer ones cut at 64. The script of a word's first letter (a table of code
point ranges) leaves as candidates only the languages that write at least
``script_share`` of their words in it. Among these a word scores the logarithm
of its letter n-grams under each language (n = 2 and 3 with word borders, smoothed,
averaged over the n-grams and scaled by the square root of their number, so that
long words do not outvote the rest). Viterbi with a penalty for each change of
language labels the words; equal neighbours form spans. The language with most
letters in its spans is the document's, and the score is its share.

Learning takes a bounded sample of whole labelled texts: of each language as
large a share, by a hash of the id, as gives ``per_language`` texts on average.
Their n-grams are counted in Spark; the tables (bounded by ``most_grams`` per
language; None keeps all) go to the tasks.

Defined cases: a text that is null or without letters is ``und`` with score 0
and no spans; a word of a script that no language writes keeps its neighbours'
language; ties go to the language first in order; null languages are not
learned; without any labelled text all is ``und``; rows that repeat a doc_id are
separate; other columns are ignored, whatever their names; no rows give no rows.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, worker_cache

PER_LANGUAGE = 1500
MOST_GRAMS = 50_000
PENALTY = 10.0
CACHE = 400_000
#: First code points of the ranges, and the script of each (Unicode blocks; "" where letters of none of these are).
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, ""), (0x0750, "arabic"), (0x0780, ""),
    (0x08A0, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"),
    (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1380, ""), (0x1780, "khmer"), (0x1800, ""), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, ""), (0x2C60, "latin"), (0x2C80, ""),
    (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0xA000, ""), (0xA640, "cyrillic"), (0xA6A0, ""), (0xA720, "latin"), (0xA800, ""), (0xAC00, "hangul"),
    (0xD7B0, ""), (0xF900, "han"), (0xFB00, "latin"), (0xFB07, ""), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, ""), (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, ""), (0x20000, "han"),
]
_STARTS = [a for a, _ in SCRIPTS]
#: A longer run of letters is cut into words of this length, so that unspaced texts are scored whole.
LONGEST_WORD = 64
_WORD = re.compile(rf"[^\W\d_]{{1,{LONGEST_WORD}}}")
UNKNOWN = "und"


def letters(text: str) -> str:
    """The text with a blank for each character that is numeric but no letter (fractions, superscripts, Roman numerals)."""
    found = "".join(_WORD.findall(text))
    if not found or found.isalpha():
        return text
    return text.translate({ord(c): " " for c in set(found) if not c.isalpha()})


def script_of(letter: str) -> str:
    return SCRIPTS[bisect_right(_STARTS, ord(letter)) - 1][1]


def grams_of(word: str) -> list[str]:
    """Letter n-grams of a lower-cased word with its borders, n = 2 and 3."""
    w = f"^{word.lower()}$"
    return [w[i : i + 2] for i in range(len(w) - 1)] + [w[i : i + 3] for i in range(len(w) - 2)]


class Model:
    """Scores words; made once in each Python worker from the bounded tables."""

    def __init__(self, languages: list[str], grams: dict[str, list[float]], unseen: list[list[float]], scripts: dict[str, list[float]], penalty: float, cache: int = CACHE):
        self.languages, self.penalty, self.most = languages, penalty, cache
        self.grams = {g: k + 3 for k, g in enumerate(grams)}
        self.logs = np.array([*unseen, *grams.values()], np.float32)  # the first three: grams never seen, by length
        self.scripts = {s: np.array(x, np.float32) for s, x in scripts.items()}
        self.none = np.zeros(len(languages), np.float32)
        self.known: dict[str, int] = {}
        self.table = np.zeros((1024, len(languages)), np.float32)
        self.lengths = np.zeros(1024, np.int32)

    def scores(self, words: list[str]) -> np.ndarray:
        """Each word's score under each language; zero for a script that none writes."""
        own = [self.scripts.get(script_of(w[0]), self.none) for w in words]
        get = self.grams.get
        grams = [grams_of(w) for w in words]
        sizes = np.array([len(g) for g in grams])
        rows = np.array([get(x, len(x) - 1) for g in grams for x in g], np.int64)
        total = np.add.reduceat(self.logs[rows], np.cumsum(sizes) - sizes) / np.sqrt(sizes)[:, None]
        allowed = np.array(own)
        return np.where(allowed > 0, total, np.where(allowed.any(1, keepdims=True), np.float32(-1e6), 0.0)).astype(np.float32)

    def codes(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Numbers of the texts' words in the table of scores, which takes up new words together."""
        known = self.known
        found = [list(map(known.get, words)) for words in texts]
        if new := list({w for words, ids in zip(texts, found) if None in ids for w, x in zip(words, ids) if x is None}):
            n = len(known)
            while n + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
            self.table[n : n + len(new)] = self.scores(new)
            self.lengths[n : n + len(new)] = list(map(len, new))
            known.update(zip(new, range(n, n + len(new))))
            found = [[known[w] if x is None else x for w, x in zip(words, ids)] if None in ids else ids for words, ids in zip(texts, found)]
        return [np.array(ids, np.int64) for ids in found]

    def forget(self) -> None:
        """Between batches: start the cache anew once it is full."""
        if len(self.known) > self.most:
            self.known = {}

    def viterbi(self, docs: list[np.ndarray]) -> list[np.ndarray]:
        """The best language of each word of each document."""
        sizes = np.array([len(d) for d in docs])
        out = [np.zeros(0, np.int8)] * len(docs)
        if not sizes.sum():
            return out
        full = np.flatnonzero(sizes)
        ends = np.cumsum(sizes[full])
        starts = ends - sizes[full]
        flat = self.table[np.concatenate([docs[i] for i in full])].astype(np.float64)
        best = np.add.reduceat(flat, starts).argmax(1)
        plain = self._never_worth_leaving(flat, starts, ends, best)
        for i, a in zip(full[plain], best[plain]):
            out[i] = np.full(sizes[i], a, np.int8)
        rest = full[~plain]
        rest = rest[np.argsort(-sizes[rest], kind="stable")]
        for at in range(0, len(rest), 512):
            for i, path in zip(rest[at : at + 512], self._steps([docs[i] for i in rest[at : at + 512]])):
                out[i] = path
        return out

    def _never_worth_leaving(self, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Documents whose best single language is the best path: no stretch gains more than half a penalty in another.

        A path with m stretches elsewhere changes language at least m - 1 times
        and, as the document's total is no higher elsewhere, m times if m is 1.
        """
        doc = np.repeat(np.arange(len(starts)), ends - starts)
        own = flat[np.arange(len(flat)), best[doc]]
        plain = np.ones(len(starts), bool)
        for k in range(len(self.languages)):
            d = flat[:, k] - own
            upto = np.cumsum(d)
            before = upto[starts] - d[starts]
            upto -= before[doc]
            fence = doc * (2 * np.abs(upto).max() + 1)  # sets each document below the ones before it
            low = np.minimum(np.minimum.accumulate(upto - fence) + fence, 0.0)
            plain &= np.maximum.reduceat(upto - low, starts) <= self.penalty / 2
        return plain

    def _steps(self, docs: list[np.ndarray]) -> list[np.ndarray]:
        """Viterbi over documents side by side, by descending length: those that have ended drop out."""
        sizes = np.array([len(d) for d in docs])
        k, steps = len(self.languages), int(sizes[0])
        live = len(docs) - np.searchsorted(sizes[::-1], np.arange(steps), side="right")
        at = np.concatenate([[0], np.cumsum(live)])
        flat = np.empty(at[-1], np.int64)
        for j, d in enumerate(docs):
            flat[at[: len(d)] + j] = d
        score = self.table[flat]
        back = np.empty((len(flat), k), np.int8)
        best = np.zeros((len(docs), k), np.float32)
        stay = np.arange(k, dtype=np.int8)
        for t in range(steps):
            now = best[: live[t]]
            top = now.argmax(1)
            jump = (now.max(1) - (self.penalty if t else 0.0))[:, None]
            moved = jump > now
            rows = slice(at[t], at[t + 1])
            back[rows] = np.where(moved, top[:, None], stay)
            new = np.where(moved, jump, now) + score[rows]
            best[: live[t]] = new - new.max(1, keepdims=True)  # only differences matter, and they stay small
        state = best.argmax(1).astype(np.int8)
        path = np.empty(len(flat), np.int8)
        for t in range(steps - 1, -1, -1):
            n = live[t]
            path[at[t] : at[t + 1]] = state[:n]
            state[:n] = back[np.arange(at[t], at[t + 1]), state[:n]]
        return [path[at[: len(d)] + j] for j, d in enumerate(docs)]


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, most_grams: int | None = MOST_GRAMS, script_share: float = 0.02, penalty: float = PENALTY, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict:
    """The tables of a model from a bounded sample of labelled texts; what reaches the driver is bounded by ``most_grams`` and the number of languages."""
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rates = rows.groupBy("lang").agg((F.lit(float(per_language)) / F.count(F.lit(1))).alias("rate"))  # a row for each language
    place = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 30)) / float(1 << 30)
    few = rows.join(F.broadcast(rates), "lang").filter(place < F.col("rate"))

    def count(batches):
        counts: dict[tuple[str, str], int] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for w in _WORD.findall(letters(text)):
                    for g in (*grams_of(w), f"#{script_of(w[0])}"):
                        counts[lang, g] = counts.get((lang, g), 0) + 1
        if counts:
            keys = list(counts)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys]), pa.array(list(counts.values()), pa.int64())], names=["lang", "gram", "n"])

    counted = few.select("lang", "text").mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    if most_grams is not None:
        counted = counted.withColumn("r", F.row_number().over(top)).filter(F.col("gram").startswith("#") | (F.col("r") <= most_grams))
    by_gram = counted.groupBy("gram").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("n")).collect()
    languages = sorted({x for r in by_gram for x in r.n})
    if not languages:
        return {"languages": [], "grams": {}, "unseen": [], "scripts": {}, "penalty": penalty}
    order = {"languages": languages, "penalty": penalty}
    size = lambda r: 0 if r.gram.startswith("#") else len(r.gram)
    totals = np.zeros((4, len(languages)))
    kinds = np.zeros(4)
    for r in by_gram:
        totals[size(r)] += [r.n.get(x, 0) for x in languages]
        kinds[size(r)] += 1
    smooth = 0.5
    logs = lambda n, k: (np.log(n + smooth) - np.log(totals[k] + smooth * (kinds[k] + 1))).tolist()
    grams = {r.gram: logs(np.array([r.n.get(x, 0) for x in languages]), size(r)) for r in by_gram if size(r)}
    unseen = [logs(np.zeros(len(languages)), k) for k in (1, 2, 3)]
    share = lambda r: [float(r.n.get(x, 0) / max(totals[0][i], 1) >= script_share) for i, x in enumerate(languages)]
    scripts = {r.gram[1:]: share(r) for r in by_gram if not size(r) and any(share(r))}
    return order | {"grams": grams, "unseen": unseen, "scripts": scripts}


def predict(docs: DataFrame, tables: dict, id_col: str = "doc_id", text_col: str = "text", with_spans: bool = True) -> DataFrame:
    """doc_id, lang_pred, score and, if asked, spans: array of (start, end, lang), code points from the first word to the last."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())])
    fields = [src.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())] + [T.StructField("spans", T.ArrayType(span))] * with_spans
    shared, key = docs.sparkSession.sparkContext.broadcast(tables), uuid.uuid4().hex

    def run(batches):
        for b in batches:
            for part in slices(b, 1):
                m = worker_cache(f"language:{key}", lambda: Model(**shared.value)) if shared.value["languages"] else None
                texts = [letters(t or "") for t in part.column(1).to_pylist()]
                langs, scores, spans = [], [], []
                codes = m.codes([_WORD.findall(t) for t in texts]) if m else [()] * len(texts)
                for text, own, path in zip(texts, codes, m.viterbi(codes) if m else codes):
                    if not len(path):
                        langs.append(UNKNOWN)
                        scores.append(0.0)
                        spans.append([])
                        continue
                    weight = np.bincount(path, m.lengths[own], len(m.languages))
                    top = int(weight.argmax())
                    langs.append(m.languages[top])
                    scores.append(float(weight[top] / weight.sum()))
                    if with_spans:
                        edges = [0, *(np.flatnonzero(np.diff(path)) + 1), len(path)]
                        places = [w.span() for w in _WORD.finditer(text)]
                        spans.append([{"start": places[i][0], "end": places[j - 1][1], "lang": m.languages[path[i]]} for i, j in zip(edges, edges[1:])])
                if m:
                    m.forget()
                cols = [part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
                if with_spans:
                    cols.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))))
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    return src.mapInArrow(run, T.StructType(fields))


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))
