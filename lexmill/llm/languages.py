"""Problem 7: the languages of a text and of its stretches, each with a confidence.

Hyperdimensional profiles. Every letter has a random vector of +-1 drawn from its code point; an n-gram is the product
of its letters' vectors, each rotated by its place; a text is the sum of its n-grams, as often as they occur in it. A
language is the sum over its reference sentences, less what all languages have in common; texts are compared with
languages by cosine. As a sum's product with a language is the sum of its n-grams' products, those are computed once
per n-gram and kept, and no long vector is built per text. The length of the sum is taken from the counts of its
different n-grams as if their vectors were orthogonal; a test compares the result with bundled vectors.

The confidence is the language's share in a soft maximum of the cosines times the root of the number of n-grams,
scaled so that it is most likely true on references left out of the profiles.

Texts are cut at ends of sentences and lines; the pieces' cosines are smoothed by Viterbi with a price for a change of
language, and neighbours of one language make one stretch. Characters are brought to their one form first, so
full-width or look-alike letters do not mislead.

Cases: null and blank texts have no stretches; text without letters has language null and confidence 0; labels are
compared after their spelling is brought to the reference's (case, outer blanks, hyphens, short codes); placeholders
and empty labels name no language; texts of any length are read whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ._common import hash_sample, pick, slices, spread
from .lookalikes import ALIKE
from .markup import mask

DIM = 4_096
#: prototypes are rounded to multiples of its inverse
GRAIN = 1 << 20
#: price of a change of language between pieces, in units of (cosine * square root of the number of n-grams)
CHANGE = 0.6
#: least n-grams and least cosine of a stretch that is evidence for its language, and its least lead over the next; random
#: vectors of DIM dimensions have cosines of a deviation of 0.0156, so the lead is one and the cosine over two deviations
LEAST_GRAMS, LEAST_COSINE, LEAST_LEAD = 8, 0.04, 0.015
#: reference sentences used, and labelled texts beside them, at most so many; and how long these may be
TRAIN_REFS, TRAIN_TEXTS, TRAIN_CHARS = 20_000, 6_000, 2_000
#: n-grams of words kept by a worker between two batches
N_KEPT = 5_000_000

_PIECE = re.compile(r"[^\n.!?。！？।؟…]*(?:[.!?।؟…]+(?=[^\s\w]*\s|[^\s\w]*$)|[。！？]+|[.!?।؟…]+(?=\S)|\n+|$)[”»“’」\")\]]*")
#: a run of letters, with marks and characters without ink inside it
_RUN = regex.compile(r"\p{L}[\p{L}\p{M}\u00ad\u200b-\u200d\u2060\ufeff]*")
_NO_INK = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
_FOLD = str.maketrans(ALIKE)


def plain_word(w: str) -> str:
    """A run of letters in its one form, lower case."""
    return w.lower() if w.isascii() else unicodedata.normalize("NFKC", w.translate(_NO_INK)).translate(_FOLD).lower()


def word_grams(w: str) -> list[str]:
    """Letters that are not ASCII, alone; pairs in scripts of many signs; threes and fours, with the ends, in others."""
    out = [c for c in w if not c.isascii()]
    if ord(w[0]) >= 0x2E80:
        return out + [w[i : i + 2] for i in range(len(w) - 1)]
    w = f" {w} "
    out += [w[i : i + 3] for i in range(len(w) - 2)]
    out += [w[i : i + 4] for i in range(len(w) - 3)]
    return out


_letters: dict[str, np.ndarray] = {}


def letter_vector(c: str) -> np.ndarray:
    v = _letters.get(c)
    if v is None:
        v = _letters[c] = np.random.default_rng(ord(c) * 2654435761 % 2**32).integers(0, 2, DIM).astype(np.int8) * 2 - 1
    return v


def gram_vectors(grams: list[str]) -> np.ndarray:
    """One vector of +-1 an n-gram: the letters' vectors, each rotated by its distance from the end, multiplied."""
    letters = sorted({c for g in grams for c in g})
    at = {c: i for i, c in enumerate(letters)}
    base = np.stack([letter_vector(c) for c in letters])
    out = base[[at[g[-1]] for g in grams]]
    for k in range(1, max(map(len, grams))):
        turned = np.roll(base, k, axis=1)
        rows = [i for i, g in enumerate(grams) if len(g) > k]
        out[rows] *= turned[[at[grams[i][-1 - k]] for i in rows]]
    return out


def products(grams: list[str], protos: np.ndarray) -> np.ndarray:
    """Cosines of n-grams with the (unit) prototypes. The prototypes are multiples of 1 / GRAIN, so the sums are exact and
    the same in whatever company an n-gram is computed."""
    out = np.empty((len(grams), len(protos)), np.float32)
    for lo in range(0, len(grams), 1024):
        out[lo : lo + 1024] = gram_vectors(grams[lo : lo + 1024]).astype(np.float64) @ protos.T / np.sqrt(DIM)
    return out


class Profiles:
    """names: languages; protos: unit vectors, one a language; worth: how telling an n-gram is (1 if it was not seen);
    heat: what a text's cosines times the root of its n-grams are multiplied by to give log odds of the languages.

    Texts are measured by the batch. Words and n-grams met so far are kept in tables; when these have grown beyond
    N_KEPT they are emptied between two batches, never inside one, so what is kept never changes an answer.
    """

    def __init__(self, names: list[str], protos: np.ndarray, worth: dict[str, float], heat: float = 1.0, known: np.ndarray | None = None):
        self.names, self.protos, self.worth, self.heat = names, np.round(protos.astype(np.float64) * GRAIN) / GRAIN, worth, heat
        #: products of the n-grams of `worth`, in its order
        self.known = products(list(worth), self.protos) if known is None and worth else known
        self.forget()

    def forget(self) -> None:
        self.words: dict[str, int] = {}  # row of each word in the three below
        self.word_grams: list[np.ndarray] = []
        self.word_dots = np.zeros((0, len(self.names)), np.float32)
        self.word_sizes = np.zeros(0, np.int64)
        self.kept = 0
        self.ids: dict[str, int] = {g: i for i, g in enumerate(self.worth)}
        self.dots = self.known if self.worth else np.zeros((0, len(self.names)), np.float32)
        self.weight = np.fromiter(self.worth.values(), np.float32, len(self.worth))

    def rows_of(self, words: list[str]) -> np.ndarray:
        """The words' rows. Of words not met before, the n-grams' products are computed at once, and their sums by word."""
        fresh = [w for w in words if w not in self.words]
        grams = [word_grams(p) if (p := plain_word(w)) else [] for w in fresh]
        new = sorted({g for gs in grams for g in gs if g not in self.ids})
        if new:
            for g in new:
                self.ids[g] = len(self.ids)
            self.dots = np.concatenate([self.dots, products(new, self.protos)])
            self.weight = np.concatenate([self.weight, np.ones(len(new), np.float32)])
        if fresh:
            ids = [np.array([self.ids[g] for g in gs], np.int64) for gs in grams]
            size = np.array([len(x) for x in ids])
            flat = np.concatenate(ids)
            dots = np.zeros((len(fresh), len(self.names)), np.float32)
            some = np.flatnonzero(size)
            if len(some):
                dots[some] = np.add.reduceat(self.weight[flat][:, None] * self.dots[flat], (np.cumsum(size) - size)[some])
            for w in fresh:
                self.words[w] = len(self.words)
            self.word_grams += ids
            self.word_dots = np.concatenate([self.word_dots, dots])
            self.word_sizes = np.concatenate([self.word_sizes, size])
            self.kept += int(size.sum()) + len(fresh)
        return np.array([self.words[w] for w in words], np.int64)

    def sums(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The bundle of each part: (products with the languages, n-grams); and (part * n-grams known + n-gram, count).

        The product with a language is the sum of the words' products, which are those of their n-grams, exactly.
        """
        if self.kept > N_KEPT:
            self.forget()
        runs = [_RUN.findall(p) for p in parts]
        flat = [w for ws in runs for w in ws]
        dot, many = np.zeros((len(parts), len(self.names)), np.float32), np.zeros(len(parts))
        if not flat:
            return dot, many, np.zeros(0, np.int64), np.zeros(0, np.int64)
        names = sorted(set(flat))
        at = dict(zip(names, self.rows_of(names).tolist()))
        word = np.array([at[w] for w in flat])
        n_words = np.array([len(ws) for ws in runs])
        some = np.flatnonzero(n_words)
        first = (np.cumsum(n_words) - n_words)[some]
        dot[some] = np.add.reduceat(self.word_dots[word], first)
        n = self.word_sizes[word]
        many[some] = np.add.reduceat(n, first)
        grams = np.concatenate([self.word_grams[w] for w in word.tolist()])
        return dot, many, *np.unique(np.repeat(np.repeat(np.arange(len(parts)), n_words), n) * len(self.ids) + grams, return_counts=True)

    def squares(self, key: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
        """Squared lengths of bundles, as of sums of orthogonal vectors, which random vectors of so many dimensions
        nearly are. Rounded, as the order of the sum depends on which n-grams were met before."""
        return np.round(np.bincount(key // len(self.ids), (count * self.weight[key % len(self.ids)].astype(np.float64)) ** 2, minlength=n), 6)

    def cosines(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cosine of each text's bundle with each language, and the number of its n-grams."""
        dot, many, key, count = self.sums(texts)
        return dot / np.sqrt(np.maximum(self.squares(key, count, len(texts)), 1e-12))[:, None], many

    def stretches_of(self, texts: list[str]) -> list[list[tuple[int, int, int, float, int, float, float]]]:
        """For each text (start, end, language or -1, cosine, n-grams, lead, confidence) by Viterbi over its pieces."""
        out: list[list] = [[] for _ in texts]
        own, spans, parts = [], [], []
        for i, text in enumerate(texts):
            for m in _PIECE.finditer(text):
                if m.end() > m.start() and not (s := m.group(0)).isspace():
                    own.append(i)
                    spans.append(m.span())
                    parts.append(s)
        if not parts:
            return out
        dot, many, key, count = self.sums(parts)
        gain = dot * np.sqrt(many / np.maximum(self.squares(key, count, len(parts)), 1e-12))[:, None]
        stretch = np.zeros(len(parts), np.int64)
        langs: list[int] = []
        owner = np.array(own)
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        # a text whose pieces together lose no more by one language than one change costs stays in that language: no
        # other path can have a greater sum
        total = np.add.reduceat(gain, first)
        one = total.argmax(1)
        lost = np.add.reduceat(gain.max(1), first) - total[np.arange(len(first)), one]
        for t, (lo, hi) in enumerate(zip(first.tolist(), [*first[1:].tolist(), len(own)])):
            tag = [int(one[t])] * (hi - lo) if lost[t] <= CHANGE else self._path(gain[lo:hi])
            for i in range(lo, hi):
                if i == lo or tag[i - lo] != tag[i - lo - 1]:
                    langs.append(tag[i - lo])
                stretch[i] = len(langs) - 1
        begin = np.flatnonzero(np.r_[True, stretch[1:] != stretch[:-1]])
        key = stretch[key // len(self.ids)] * len(self.ids) + key % len(self.ids)
        order = np.argsort(key, kind="stable")
        key, count = key[order], count[order]
        if len(key):
            at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            key, count = key[at], np.add.reduceat(count, at)
        cos = np.add.reduceat(dot, begin) / np.sqrt(np.maximum(self.squares(key, count, len(langs)), 1e-12))[:, None]
        many = np.add.reduceat(many, begin)
        odds = self.heat * cos * np.sqrt(many)[:, None]
        odds -= odds.max(1, keepdims=True)
        sure = np.exp(odds) / np.exp(odds).sum(1, keepdims=True)
        begin = begin.tolist()
        for s, (lo, hi) in enumerate(zip(begin, [*begin[1:], len(own)])):
            k, m = langs[s], int(many[s])
            rest = float(np.delete(cos[s], k).max()) if len(self.names) > 1 else 0.0
            out[own[lo]].append((spans[lo][0], spans[hi - 1][1], k if m else -1, float(cos[s, k]) if m else 0.0, m, float(cos[s, k]) - rest, float(sure[s, k]) if m else 0.0))
        return out

    def _path(self, gain: np.ndarray) -> list[int]:
        n, k = gain.shape
        best, back = gain[0].copy(), np.zeros((n, k), np.int64)
        for i in range(1, n):
            top = int(best.argmax())
            stay = best >= best[top] - CHANGE
            back[i] = np.where(stay, np.arange(k), top)
            best = np.where(stay, best, best[top] - CHANGE) + gain[i]
        tag = [0] * n
        tag[-1] = int(best.argmax())
        for i in range(n - 1, 0, -1):
            tag[i - 1] = int(back[i, tag[i]])
        return tag

    def stretches(self, text: str) -> list[tuple[int, int, int, float, int, float, float]]:
        return self.stretches_of([text])[0]

    def spoken_of(self, texts: list[str]) -> list[list[str]]:
        """Languages in which each text has at least one whole sentence."""
        return [sorted({self.names[k] for _, _, k, cos, m, lead, _ in st if k >= 0 and m >= LEAST_GRAMS and cos >= LEAST_COSINE and lead >= LEAST_LEAD}) for st in self.stretches_of(texts)]

    def spoken(self, text: str) -> list[str]:
        return self.spoken_of([text])[0]


def build_profiles(refs: list[tuple[str, str]], heat: float = 1.0) -> Profiles:
    """From (language, text); bounded by the references and the bounded sample of labelled texts."""
    names = sorted({a for a, _ in refs})
    at = {n: k for k, n in enumerate(names)}
    counts: list[dict[str, int]] = [{} for _ in names]
    for lang, t in refs:
        c = counts[at[lang]]
        for w in _RUN.findall(t):
            if p := plain_word(w):
                for g in word_grams(p):
                    c[g] = c.get(g, 0) + 1
    total = [max(1, sum(c.values())) for c in counts]
    share: dict[str, float] = {}
    most: dict[str, float] = {}
    for c, t in zip(counts, total):
        for g, n in c.items():
            share[g] = share.get(g, 0.0) + n / t
            most[g] = max(most.get(g, 0.0), n / t)
    # an n-gram is worth as much as its use leans to one language
    worth = {g: (most[g] / share[g]) ** 2 for g in share}
    grams = list(worth)
    sums = np.zeros((len(names), DIM), np.float64)
    for lo in range(0, len(grams), 1024):
        some = grams[lo : lo + 1024]
        use = np.array([[worth[g] * np.log1p(c[g] * 20_000 / t) if g in c else 0.0 for c, t in zip(counts, total)] for g in some], np.float32)
        sums += use.T @ gram_vectors(some).astype(np.float32)
    sums /= np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    if len(names) > 1:
        sums -= sums.mean(0)
    sums /= np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return Profiles(names, sums.astype(np.float32), worth, heat)


def calibrated_heat(refs: list[tuple[str, str]]) -> float:
    """The heat that makes confidences most likely true: profiles of one half of the references are tried on whole
    sentences, halves and quarters of the other half."""
    half = [zlib.crc32(t.encode("utf-8", "surrogatepass")) % 2 == 0 for _, t in refs]
    made = build_profiles([r for r, h in zip(refs, half) if h])
    trials = [(lang, t[len(t) * i // n : len(t) * (i + 1) // n]) for (lang, t), h in zip(refs, half) if not h and lang in made.names for n in (1, 2, 4) for i in range(n)]
    if not trials:
        return 1.0
    cos, many = made.cosines([t for _, t in trials])
    x = cos * np.sqrt(many)[:, None]
    right = np.array([made.names.index(lang) for lang, _ in trials])
    loss = {}
    for heat in np.geomspace(0.1, 30, 60):
        z = heat * x
        z -= z.max(1, keepdims=True)
        loss[float(heat)] = float(np.mean(np.log(np.exp(z).sum(1)) - z[np.arange(len(z)), right]))
    return min(loss, key=loss.get)


def widen(first: Profiles, refs: list[tuple[str, str]], labelled: list[tuple[str, str]]) -> Profiles:
    """Profiles from the references and those labelled texts that are wholly in the language of their label."""
    heard = first.stretches_of([t for _, t in labelled])
    extra = [(lang, t) for (lang, t), st in zip(labelled, heard) if {first.names[x[2]] for x in st if x[2] >= 0 and x[4] >= 6} == {lang}]
    return build_profiles(refs + extra, calibrated_heat(refs))


def label_names(refs: list[tuple[str, str]]) -> dict[str, str]:
    """Spellings (folded) of each language: its name, its name's first part, its short code."""
    out: dict[str, str] = {}
    for lang, short in sorted(set(refs)):
        for s in (lang, lang.split("_")[0], short):
            if s:
                out.setdefault(fold_label(s), lang)
    return out


def fold_label(s: str | None) -> str:
    return re.sub(r"[-\s]+", "_", unicodedata.normalize("NFKC", s or "").strip().lower())


_made: dict[str, Profiles] = {}


def train(refs: DataFrame, labelled: list[DataFrame], most: int = TRAIN_TEXTS) -> tuple[Profiles, dict[str, str]]:
    """Profiles and label spellings. refs: (sonar_lang, short_code, text), of which at most TRAIN_REFS are used;
    labelled: (label, text) frames, of which a hash sample of at most `most` texts is used. Profiles made from the same
    texts before are used again."""
    known_refs = refs.select("sonar_lang", "short_code", "text").filter("sonar_lang is not null")
    rows = sorted((r[0], r[1] or "", r[2] or "") for r in hash_sample(known_refs, "text", TRAIN_REFS).collect())
    known = label_names([(a, b) for a, b, _ in rows])
    base = [(a, t) for a, _, t in rows]
    extra: list[tuple[str, str]] = []
    for df in labelled:
        d = df.select("label", "text").filter(f"label is not null and text is not null and length(text) < {TRAIN_CHARS}")
        extra += [(lang, mask(t)) for label, t in sorted(hash_sample(d, "text", most // len(labelled)).collect()) if (lang := known.get(fold_label(label)))]
    key = hashlib.sha256(repr((base, extra)).encode("utf-8", "surrogatepass")).hexdigest()
    if key not in _made:
        if len(_made) > 3:
            _made.clear()
        _made[key] = widen(build_profiles(base), base, extra)
    return _made[key], known


def _mapped(df: DataFrame, profiles: Profiles, answer: Callable[[Profiles, pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """`answer` for slices of Arrow batches that hold about a million bytes of text in column 1, or one text."""
    shared = df.sparkSession.sparkContext.broadcast((profiles.names, profiles.protos, profiles.worth, profiles.heat, profiles.known))
    cell: list[Profiles] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not cell:
            cell.append(Profiles(*shared.value))
        for b in batches:
            for lo, hi in slices(b.column(1)):
                if (out := answer(cell[0], b.slice(lo, hi - lo))) is not None:
                    yield out

    return spread(df).mapInArrow(run, schema)


def language_stretches(df: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start_at, end_at, language, cosine, confidence): every stretch of every text, offsets in code points. A map.

    The confidence is the calibrated probability of the language among those known."""

    def answer(p: Profiles, b: pa.RecordBatch) -> pa.RecordBatch | None:
        got = p.stretches_of([mask(t) if t else "" for t in b.column(1).to_pylist()])
        rows = [(r, *x) for r, st in enumerate(got) for x in st]
        if not rows:
            return None
        at, start, end, lang, cos, _, _, sure = zip(*rows)
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.float64())
        cols = (start, end, [p.names[k] if k >= 0 else None for k in lang], [round(x, 6) for x in cos], [round(x, 6) for x in sure])
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, k) for c, k in zip(cols, kinds)]], [id_col, "start_at", "end_at", "language", "cosine", "confidence"])

    k = df.schema[id_col].dataType.simpleString()
    return _mapped(pick(df, **{"id": id_col, "text": text_col}), profiles, answer, f"`{id_col}` {k}, start_at int, end_at int, language string, cosine double, confidence double")


def missing_languages(df: DataFrame, profiles: Profiles, labels: dict[str, str], id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(id, sonar_lang): one row for each language of a whole sentence of the text that the label does not name."""

    def answer(p: Profiles, b: pa.RecordBatch) -> pa.RecordBatch | None:
        spoken = p.spoken_of([mask(t) if t and not t.isspace() else "" for t in b.column(1).to_pylist()])
        own = [labels.get(fold_label(x)) for x in b.column(2).to_pylist()]
        rows = [(r, g) for r, (gs, o) in enumerate(zip(spoken, own)) for g in gs if g != o]
        if not rows:
            return None
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array([r for r, _ in rows], pa.int64())), pa.array([g for _, g in rows], pa.string())], [id_col, "sonar_lang"])

    k = df.schema[id_col].dataType.simpleString()
    return _mapped(pick(df, **{"id": id_col, "text": text_col, "label": label_col}), profiles, answer, f"`{id_col}` {k}, sonar_lang string")
