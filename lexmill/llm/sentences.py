"""Problem 2: sentence units of texts in many languages and scripts.

A linear-chain conditional random field over two tags, *begins a unit* and *inside*, decoded by Viterbi. In scripts
that part no words by spaces every character is tagged (but not marks written on the character before). In scripts
that do, a character inside a word is inside by definition, and so is a lower-case letter after a word without a mark;
all others after white space or a mark are tagged. Evidence is what stands on both sides: the marks, the word before
(abbreviations, initials, numbers), the word after, the state of quotations and brackets, line breaks; and inside a
run of characters without spaces or closing marks, the characters before and after and how long the run is.

The model is trained here, on reference sentences and a bounded sample of delivered units joined into running texts
with the separators, line wraps and asides that texts have (the asides are those of the corpus). Part of the joined
texts in scripts that can do without marks is stripped of punctuation and, where no spaces are written, joined by
nothing, so that such texts are cut by their characters.

Cases: null and blank texts have no units; an empty table gives no rows; white space around units belongs to none;
texts of any length are decoded whole; repeated rows give repeated units; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import hash_sample, map_arrow, pick, spread

#: delivered units, and reference sentences, used for training, at most so many of each (the least hashes)
TRAIN_UNITS, TRAIN_REFS = 6_000, 20_000
#: texts of the corpus in which asides are looked for, at most; and how long a text may be to be trained on
ASIDE_TEXTS, TRAIN_CHARS = 2_000, 400
#: evidence against a cut (log odds) that the first model must exceed to be sure that a unit is only a piece
UNSURE = -3.0
#: joined texts made from them
TRAIN_TEXTS = 3_600
#: a word counts as an abbreviation from this share of all stops inside units on, so there are at most 1 / share words
LEAST_SHARE = 1e-5
#: sums of evidence a worker keeps between two texts
SUMS_KEPT = 300_000
#: hashed evidence inside runs without spaces: buckets, and how many to a place
BUCKETS, RUN_WIDTH = 1 << 20, 11

#: Marks that open and close, and marks that may end a sentence.
OPEN = "“‘„«『「([{（【"
CLOSE = "”’“»』」)]}）】"
PLAIN_QUOTES = "\"'"
END = ".!?…。！？।؟॥．"
#: Blocks of scripts that part no words by spaces, beside Han and kana.
SOUTHERN = ((0x0E00, 0x1000), (0x1000, 0x10A0), (0x1780, 0x1800), (0x1A20, 0x1AB0))
HAN_KANA = ((0x2E80, 0x3000), (0x3005, 0x3008), (0x3040, 0x3100), (0x31F0, 0x3200), (0x3400, 0xA000), (0xF900, 0xFB00), (0x20000, 0x323B0))

_LAST_WORD = re.compile(r"([^\W\d_](?:[\w.'’-]*\w)?)[.]\W*$")
_TAIL = re.compile(r"[\s\xa0]?[.!?。！？।؟]?[”»“’」\")]*[.]?$")
_WORD = re.compile(r"\w+(?:[.\-'’]\w+)*", re.UNICODE)
_STATE_MARKS = re.compile("[" + re.escape(OPEN + CLOSE + PLAIN_QUOTES) + "]|\n(?=\n)")


def _kind(c: str) -> str:
    if c in END:
        return "E"
    if c in OPEN or c in CLOSE or c in PLAIN_QUOTES:
        return "Q"
    k = unicodedata.category(c)
    if k in ("Lu", "Lt"):
        return "U"
    if k == "Ll":
        return "l"
    if k[0] == "N":
        return "9"
    if k[0] == "L" or k[0] == "M":
        o = ord(c)
        return "T" if any(lo <= o < hi for lo, hi in SOUTHERN) else "D" if 0x900 <= o < 0x980 else "A" if 0x600 <= o < 0x700 else "J" if 0x3040 <= o < 0x3100 else "C" if o >= 0x2E80 else "L"
    if k[0] == "P":
        return c if c in ",;:—-–، ،、，" else "P"
    return "s" if c.isspace() else "S"


_kinds: dict[str, str] = {}


def kind(c: str) -> str:
    k = _kinds.get(c)
    if k is None:
        k = _kinds[c] = _kind(c)
    return k


#: classes of characters: letter of an unspaced script, other letter or digit, mark on the character before, white space,
#: mark that ends a sentence, such a mark or a quotation mark or bracket, small letter, what a small letter may follow as
#: a new unit's beginning, closing mark, comma
UNSPACED, WORD, ABOVE, SPACE, FINAL, MARK, LOWER, ENDS, CLOSER, COMMA = (1 << x for x in range(10))


def _classes() -> np.ndarray:
    t = np.zeros(0x32400, np.uint16)
    for c in range(len(t)):
        ch = chr(c)
        k, mine = unicodedata.category(ch), _kind(ch)
        t[c] = WORD * (k[0] in "LN") | ABOVE * (k[0] == "M") | SPACE * ch.isspace() | LOWER * (mine == "l") | ENDS * (mine in ("E", "Q", "P", "S") or ch in ":;、") | COMMA * (ch == ",")
    for lo, hi in SOUTHERN + HAN_KANA:
        t[lo:hi] |= np.where(t[lo:hi] & (WORD | ABOVE) > 0, UNSPACED, 0).astype(np.uint16)
    for c in END:
        t[ord(c)] |= FINAL | MARK
    for c in OPEN + CLOSE + PLAIN_QUOTES:
        t[ord(c)] |= MARK
    for c in ")]}）】」』»”":
        t[ord(c)] |= CLOSER
    return t


_table: list[np.ndarray] = []


def character_classes(text: str) -> np.ndarray:
    if not _table:
        _table.append(_classes())
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _table[0][np.minimum(c, len(_table[0]) - 1)]


def candidates(text: str) -> list[int]:
    """Places where a unit can begin (the first character that is not white space is not among them), found for the
    whole text at once from the classes of its characters."""
    k = character_classes(text)
    at = np.flatnonzero(k & SPACE == 0)
    if len(at) < 2:
        return []
    cur, last, gap = k[at[1:]], k[at[:-1]], np.diff(at) > 1
    ok = (gap | (last & MARK > 0)) & ((cur & LOWER == 0) | (last & ENDS > 0)) & (cur & (FINAL | COMMA) == 0) & (gap | (cur & CLOSER == 0))
    return at[1:][ok].tolist()


def _shape(w: str) -> str:
    s = "".join(kind(c) for c in w[:6])
    return re.sub(r"(.)\1+", r"\1+", s)


def _after(after: str, nxt: str, two: str, three: str, first: str) -> list[str]:
    return [f"f{first}", f"a{after}", f"x{_shape(after)}|{nxt}", f"2{two}", f"3{three}"]


def _ending(end2: str, end4: str, g: str) -> list[str]:
    return [f"e{end2}", f"e4{end4}", f"eg{end4}|{g}"]


def _signs(marks: str, closers: str, g: str, first: str, kb: str, num: str, depth: int, mark: str, lead: str, kj: str, p0: str) -> list[str]:
    sig, d = f"{marks}|{closers}|{g}", f"{min(depth, 2)}{mark}"
    return [
        "1", f"g{g}", f"m{marks}", f"c{closers}", f"s{sig}", f"sf{sig}|{first}", f"d{d}", f"dg{d}|{g}{marks}", f"n{num}{kb}|{marks}|{first}",
        f"L{lead}|{marks}{closers}", f"Lf{lead}|{marks}{closers}|{first}", f"t{kb}{first}{g}", f"k{kj}{first}{g}", f"p{p0}{first}", f"b{marks}|{closers}|{first}|{kb}",
    ]


def _word(before: str, marks: str, first: str) -> list[str]:
    return [f"w{before}|{marks}", f"wn{before}|{marks}|{first}"]


def _both(before: str, marks: str, after: str, closers: str, g: str, lead: str, end2: str, two: str) -> list[str]:
    return [f"wa{before[-5:]}|{marks}|{after[:5].lower()}", f"am{after}|{marks}{closers}|{g}", f"La{lead}|{closers}|{after[:4]}", f"et{end2}|{two}"]


#: evidence by what it is made of, each function with the places of its arguments in a context
GROUPS = ((_after, (0, 1, 2, 3, 4)), (_ending, (5, 6, 7)), (_signs, (8, 9, 7, 4, 10, 11, 12, 13, 14, 15, 16)), (_word, (17, 8, 4)), (_both, (17, 8, 0, 9, 7, 14, 5, 2)))
#: places in a row of `features` of the evidence that can single out one sentence; left out of the first model
PARTICULAR = (1, 2, 4, 6, 7, 25, 26, 27, 28)


def features(text: str, places: list[int], short: frozenset[str] = frozenset()) -> list[list[str]]:
    """Evidence for each place."""
    return [[x for f, args in GROUPS for x in f(*[c[k] for k in args])] for c in contexts(text, places, short)]


def contexts(text: str, places: list[int], short: frozenset[str] = frozenset()) -> list[tuple]:
    """What stands around each place; one pass over the text's marks for the state of quotations and brackets."""
    if not places:
        return []
    n = len(text)
    out = []
    stack: list[tuple[str, int]] = []  # open marks and where
    closed = ("", -1, -1)  # the last closed pair: mark, where it opened, where it closed
    state: list[tuple] = []
    todo = iter(places)
    place = next(todo)
    for m in _STATE_MARKS.finditer(text):
        i = m.start()
        while place is not None and place <= i:
            state.append((len(stack), stack[-1][0] if stack else "", closed))
            place = next(todo, None)
        if place is None:
            break
        c = text[i]
        if c in PLAIN_QUOTES:
            if c == "'" and i and text[i - 1].isalnum() and i + 1 < n and text[i + 1].isalnum():
                continue
            if stack and stack[-1][0] == c:
                closed = (c, stack.pop()[1], i)
            elif not i or not text[i - 1].isalnum():
                stack.append((c, i))
        elif c == "“" and stack and stack[-1][0] == "„":
            closed = ("„", stack.pop()[1], i)
        elif c in OPEN:
            stack.append((c, i))
        elif c in CLOSE:
            if stack and not (c == "’" and stack[-1][0] != "‘"):
                closed = (stack[-1][0], stack.pop()[1], i)
        else:
            stack.clear()  # an unclosed mark does not reach beyond a paragraph
    state += [(len(stack), stack[-1][0] if stack else "", closed)] * (len(places) - len(state))
    for i, (depth, mark, (_, co, cc)) in zip(places, state):
        j = i - 1
        while text[j].isspace():
            j -= 1
        gap = text[j + 1 : i]
        g = "0" if not gap else "P" if gap.count("\n") > 1 else "N" if "\n" in gap else "2" if len(gap) > 1 else "1" if gap == " " else "n"
        # what closes the text before: brackets and quotation marks, then the mark that ends it
        e, closers = j, ""
        while e >= 0 and text[e] in CLOSE + PLAIN_QUOTES and len(closers) < 3:
            closers = text[e] + closers
            e -= 1
        p0 = text[e] if e >= 0 else "^"
        k = e
        marks = ""
        while k >= 0 and (text[k] in END or text[k] in ":,;") and len(marks) < 3:
            marks = text[k] + marks
            k -= 1
        while k >= 0 and text[k] == "\xa0":
            k -= 1
        b = k
        while b >= 0 and k - b < 12 and (text[b].isalnum() or unicodedata.category(text[b])[0] == "M" or text[b] in ".'’-"):
            b -= 1
        before = text[b + 1 : k + 1].lower()
        if marks and before in short:
            marks = "a" + marks  # the mark belongs to the word: evidence of marks that end sentences does not apply
        m = _WORD.match(text, i)
        after = (m.group(0) if m else text[i : i + 1])[:10]
        first = kind(text[i])
        nxt = text[i + len(after) : i + len(after) + 1]
        kb = kind(before[-1]) if before else "^"
        two, three = text[i : i + 2], text[i : i + 4]
        end2, end4 = text[max(0, j - 1) : j + 1], text[max(0, j - 3) : j + 1]
        # a quotation that has just ended: what led to it
        lead = ""
        if closers and cc >= 0 and cc >= e:
            q = co - 1
            while q >= 0 and text[q].isspace():
                q -= 1
            lead = "^" if q < 0 or text[q] in END or text[q] == "\n" or "\n" in text[q + 1 : co] and text[q] not in ",:" else text[q] if text[q] in ":,：，" else "w"
        num = "9" if before.isdigit() else "i" if len(before) == 1 and before.isalpha() else "a" if "." in before else "w"
        out.append((after, nxt, two, three, first, end2, end4, g, marks, closers, kb, num, depth, mark, lead, kind(text[j]), p0, before))
    return out


_UNSPACED = re.compile("[" + "".join(f"{chr(lo)}-{chr(hi - 1)}" for lo, hi in SOUTHERN + HAN_KANA) + "]")
_NO_PLACES = np.zeros(0, np.int64), np.zeros((0, RUN_WIDTH), np.int64)


def run_places(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places inside runs of unspaced scripts, and their evidence as hashed ids, all computed at once."""
    if not _UNSPACED.search(text):
        return _NO_PLACES
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    k = character_classes(text)
    cur, prev = k[1:], k[:-1]
    ok = (cur & (UNSPACED | WORD) > 0) & (cur & ABOVE == 0) & (prev & (SPACE | MARK) == 0) & ((cur | prev) & UNSPACED > 0)
    at = np.flatnonzero(ok) + 1
    if not len(at):
        return _NO_PLACES
    n = len(c)
    # the run between the nearest white space or closing marks on both sides
    stop = np.flatnonzero(k & (SPACE | FINAL) > 0)
    right = np.searchsorted(stop, at)
    lo = np.where(right > 0, stop[np.maximum(right - 1, 0)], -1) if len(stop) else np.full(len(at), -1)
    hi = np.where(right < len(stop), stop[np.minimum(right, len(stop) - 1)], n) if len(stop) else np.full(len(at), n)
    closed = (hi < n) & (k[np.minimum(hi, n - 1)] & FINAL > 0)
    opened = (lo >= 0) & (k[np.maximum(lo, 0)] & FINAL > 0)
    grade = lambda x: np.floor(2 * np.log2(np.maximum(x, 1))).astype(np.int64)
    whole, before, after = grade(hi - lo - 1), grade(at - lo - 1), grade(hi - at)
    o = c[at]
    script = np.where((o >= 0x3040) & (o < 0x3100), 1, np.where(k[at] & UNSPACED == 0, 2, np.where(o < 0x2E80, 3, 0)))
    pad = np.concatenate([np.zeros(4, np.int64), c, np.zeros(4, np.int64)])
    z = [pad[at + 4 + d] for d in range(-4, 4)]  # z[4] is the character at the place
    rows = ((script, whole, closed, opened), (before, after, closed), z[3:5], z[2:4], z[4:6], z[1:4], z[4:7], z[2:6], z[0:4], z[4:8], (*z[3:5], whole, closed))
    out = np.empty((len(at), RUN_WIDTH), np.int64)
    for j, parts in enumerate(rows):
        h = np.full(len(at), j + 1, np.uint64)
        for p in parts:
            h = (h ^ np.asarray(p).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        out[:, j] = (h >> np.uint64(7)) % np.uint64(BUCKETS)
    return at, out


class Model:
    """weights: evidence -> (score of begin minus inside); runs: the same for hashed evidence; step: scores of tag
    pairs; short: known abbreviations."""

    def __init__(self, weights: dict[str, float], runs: np.ndarray | None, step: np.ndarray, short: frozenset[str] = frozenset()):
        self.weights, self.runs, self.step, self.short = weights, runs, step, short
        #: sums of weights by group and arguments; emptied between two texts when there are many, which changes no sum
        self.known: list[dict[tuple, float]] = [{} for _ in GROUPS]

    def evidence(self, text: str) -> tuple[list[int], list[float]]:
        """The places of a text and what speaks for a unit's beginning there."""
        places = candidates(text)
        if sum(map(len, self.known)) > SUMS_KEPT:
            self.known = [{} for _ in GROUPS]
        get = self.weights.get
        plan = [(f, itemgetter(*args), memo) for (f, args), memo in zip(GROUPS, self.known)]
        xs = []
        for c in contexts(text, places, self.short):
            x = 0.0
            for f, pick_args, memo in plan:
                key = pick_args(c)
                part = memo.get(key)
                if part is None:
                    part = memo[key] = sum([get(a, 0.0) for a in f(*key)])
                x += part
            xs.append(x)
        at, keys = run_places(text) if self.runs is not None else _NO_PLACES
        if len(at):
            xs += self.runs[keys].sum(1).tolist()
            places += at.tolist()
            order = sorted(range(len(places)), key=places.__getitem__)
            places, xs = [places[i] for i in order], [xs[i] for i in order]
        return places, xs

    def begins(self, text: str | None) -> list[int]:
        """Where units begin, by Viterbi."""
        if not text or text.isspace():
            return []
        start = next(i for i, c in enumerate(text) if not c.isspace())
        places, xs = self.evidence(text)
        if not places:
            return [start]
        (s00, s01), (s10, s11) = self.step.tolist()
        inside, begin = -1e9, 0.0  # the first unit has begun
        back = []
        for x in xs:
            a0, b0 = inside + s00, begin + s10
            a1, b1 = inside + s01, begin + s11
            back.append((b0 > a0, b1 > a1))
            inside, begin = (b0 if b0 > a0 else a0), (b1 if b1 > a1 else a1) + x
        tag = begin > inside
        out = []
        for i, (t0, t1) in zip(reversed(places), reversed(back)):
            if tag:
                out.append(i)
                tag = t1
            else:
                tag = t0
        return [start, *reversed(out)]


def _pool(u: str) -> str:
    """The script most of a unit is in; cased scripts count as one."""
    ks = [k for c in u if (k := kind(c)) in "UlTDAJCL"]
    k = max(sorted(set(ks)), key=ks.count) if ks else "l"
    return "l" if k == "U" else "J" if k == "C" and "J" in ks else k


def without_marks(u: str, all_of_them: bool) -> str:
    """A unit without the marks at its end, or without any punctuation but that between digits."""
    u = re.sub(r"[.!?。！？।؟…”’」』\"')\]）】]+$", "", u)
    if all_of_them:
        u = "".join(c for i, c in enumerate(u) if unicodedata.category(c)[0] != "P" or u[i - 1 : i].isdigit() and u[i + 1 : i + 2].isdigit())
    return u.strip()


def joined_texts(units: list[tuple[str, str]], n: int, seed: int = 11, asides: list[str] | tuple[str, ...] = ()) -> Iterator[tuple[str, set[int]]]:
    """Running texts and where their units begin; the units of a text are of one language."""
    rng = np.random.default_rng(seed)
    pools: dict[str, list[str]] = {}
    for lang, u in units:
        u = u.strip()
        if u and "\n" not in u:
            pools.setdefault(lang, []).append(u)
    names = sorted(pools)
    if not names:
        return
    p = np.array([len(pools[k]) ** 0.25 for k in names])
    p /= p.sum()
    for _ in range(n):
        pool = pools[names[rng.choice(len(names), p=p)]]
        style = rng.random()
        out, begins = "", set()
        wrap = rng.random() < 0.3
        bare, all_of_them, glued = rng.random() < 0.45, rng.random() < 0.5, rng.random() < 0.75
        for _u in range(int(rng.integers(2, 10))):
            u = pool[int(rng.integers(len(pool)))]
            k = _pool(u)
            stripped = bare and k in "TJC"
            if asides and rng.random() < 0.12:
                aside = asides[int(rng.integers(len(asides)))]
                cut = _TAIL.search(u).start()
                u = u[:cut] + ("" if k == "T" else " ") + aside + u[cut:]
            if stripped and not (u := without_marks(u, all_of_them)):
                continue
            if wrap and k not in "TJC":
                for x in [m.start() for m in re.finditer(" ", u)]:
                    if rng.random() < 0.1:
                        u = u[:x] + "\n" + u[x + 1 :]
            if out:
                r = rng.random()
                if stripped and glued and k in "TJC":
                    pass
                elif r < 0.12:
                    out += "\n\n"
                elif style < 0.25 or r < 0.16:
                    out += "\n"
                elif k in "JC" and not stripped:
                    pass
                else:
                    out += "  " if r < 0.24 else " "
            begins.add(len(out))
            out += u
        yield out, begins


def train(units: list[tuple[str, str]], n_texts: int = TRAIN_TEXTS, seed: int = 11, short: frozenset[str] = frozenset(), asides: list[str] | tuple[str, ...] = (), whole: list[tuple[str, str]] | tuple = ()) -> Model:
    """Two passes. Delivered units are not all whole: a first model, which knows no evidence so particular that it
    could learn a wrong cut by heart, drops those it would cut inside or is sure not to cut off from their neighbours.
    Those of `whole`, reference sentences, are kept as they are."""
    # a unit of one or two words, in scripts that part words, is as a rule a piece cut off behind an abbreviation
    units = list(whole) + [(lang, u) for lang, u in units if len(u.split()) > 2 or _pool(u) in "TJC"]
    first = fit(units, n_texts, rounds=30, seed=seed, leave_out=PARTICULAR, least=5, decay=5e-5, short=short, asides=asides)
    by_pool: dict[str, list[str]] = {}
    for lang, u in units:
        by_pool.setdefault(lang, []).append(u.strip())
    probes = {k: sorted(v, key=len)[len(v) // 2] for k, v in by_pool.items()}
    kept = list(whole)
    for lang, u in units[len(kept) :]:
        u = u.strip()
        cuts = first.begins(u)[1:]
        cuts = [c for c in cuts if not ((m := _LAST_WORD.search(u[:c])) and m.group(1).lower() in short)]
        if not u or cuts:
            continue
        mid = probes[lang]
        gap = "" if _pool(u) in "JC" else " "
        x = dict(zip(*first.evidence(mid + gap + u + gap + mid)))
        if min(x.get(len(mid) + len(gap), -9.0), x.get(len(mid) + 2 * len(gap) + len(u), -9.0)) > UNSURE:
            kept.append((lang, u))
    return fit(kept or units, n_texts, rounds=70, seed=seed, short=short, asides=asides)


def fit(units: list[tuple[str, str]], n_texts: int = TRAIN_TEXTS, rounds: int = 40, seed: int = 11, least: int = 3, decay: float = 5e-6, leave_out: tuple[int, ...] = (), short: frozenset[str] = frozenset(), asides: list[str] | tuple[str, ...] = ()) -> Model:
    """Maximum likelihood of the chain by full-batch Adam; forward and backward run over all texts at once."""
    texts = []
    count: dict[str, int] = {}
    met = np.zeros(BUCKETS, np.int64)
    for text, begins in joined_texts(units, n_texts, seed, asides):
        marked = candidates(text)
        f = features(text, marked, short)
        if leave_out:
            f = [[a for x, a in enumerate(row) if x not in leave_out] for row in f]
        for row in f:
            for a in row:
                count[a] = count.get(a, 0) + 1
        at, keys = run_places(text)
        if leave_out:
            keys = keys[:, : RUN_WIDTH - 3]
        met += np.bincount(keys.ravel(), minlength=BUCKETS)
        if f or len(at):
            texts.append((marked, f, at, keys, begins))
    if not texts:
        return Model({}, None, np.zeros((2, 2)), short)
    index = {a: i for i, a in enumerate(a for a, c in count.items() if c >= least)}
    hashed = np.flatnonzero(met >= least)
    none = len(index) + len(hashed)
    lut = np.full(BUCKETS, none, np.int32)
    lut[hashed] = len(index) + np.arange(len(hashed))
    texts.sort(key=lambda x: -len(x[0]) - len(x[2]))
    size = np.array([len(x[0]) + len(x[2]) for x in texts])
    b, t = len(texts), int(size.max())
    n_marked = sum(len(x[0]) for x in texts)
    n_rows = int(size.sum())
    marked_ids = np.full((n_marked, max(len(x[1][0]) if x[1] else 1 for x in texts)), none, np.int32)
    run_ids = lut[np.concatenate([x[3] for x in texts])]
    slot, y = np.zeros((b, t), np.int64), np.zeros((b, t), np.int64)
    row, run_row = 0, n_marked
    for i, (marked, f, at, _, begins) in enumerate(texts):
        for j, x in enumerate(f):
            marked_ids[row + j] = [index.get(a, none) for a in x]
        places = np.concatenate([np.array(marked, np.int64), at])
        rows = np.concatenate([row + np.arange(len(f)), run_row + np.arange(len(at))])
        order = np.argsort(places, kind="stable")
        slot[i, : len(places)] = rows[order]
        y[i, : len(places)] = [p in begins for p in places[order].tolist()]
        row, run_row = row + len(f), run_row + len(at)
    mask = np.arange(t)[None] < size[:, None]
    live = [int(mask[:, j].sum()) for j in range(t)]
    w = np.zeros(none + 1)
    step = np.zeros((2, 2))
    mw, vw, ms, vs = np.zeros_like(w), np.zeros_like(w), np.zeros((2, 2)), np.zeros((2, 2))
    for r in range(1, rounds + 1):
        x = np.concatenate([w[marked_ids].sum(1), w[run_ids].sum(1)])
        e = np.zeros((t, b, 2))
        e[:, :, 1] = np.where(mask, x[slot], 0).T
        alpha, beta = np.zeros((t, b, 2)), np.zeros((t, b, 2))
        prev = np.tile(np.array([-1e9, 0.0]), (b, 1))
        for j in range(t):
            q = live[j]
            alpha[j, :q] = np.logaddexp(prev[:q, 0, None] + step[0], prev[:q, 1, None] + step[1]) + e[j, :q]
            prev = alpha[j]
        for j in range(t - 2, -1, -1):
            q = live[j + 1]
            nx = e[j + 1, :q] + beta[j + 1, :q]
            beta[j, :q] = np.logaddexp(step[:, 0] + nx[:, :1], step[:, 1] + nx[:, 1:])
        last = alpha[size - 1, np.arange(b)]
        z = np.logaddexp(last[:, 0], last[:, 1])
        post = np.exp(alpha[:, :, 1] + beta[:, :, 1] - z).T
        err = np.zeros(n_rows)
        err[slot[mask]] = (post - y)[mask]
        grad = decay * w * n_rows / b
        for part, k in ((marked_ids, err[:n_marked]), (run_ids, err[n_marked:])):
            grad += np.bincount(part.ravel(), np.repeat(k, part.shape[1]), minlength=none + 1) / b
        # tag pairs: expected less observed
        gs = np.zeros((2, 2))
        start = np.tile(np.array([-1e9, 0.0]), (b, 1))
        for j in range(t):
            q = live[j]
            before = start[:q] if j == 0 else alpha[j - 1, :q]
            pr = np.exp(before[:, :, None] + step[None] + (e[j, :q] + beta[j, :q])[:, None, :] - z[:q, None, None])
            gs += pr.sum(0)
            yp = np.ones(q, np.int64) if j == 0 else y[:q, j - 1]
            gs -= np.bincount(2 * yp + y[:q, j], minlength=4).reshape(2, 2)
        gs = gs / b + 1e-3 * step
        grad[none] = 0
        for g, m, v, target in ((grad, mw, vw, w), (gs, ms, vs, step)):
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            target -= 0.25 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
        w[none] = 0
    runs = None
    if len(hashed):
        runs = np.zeros(BUCKETS, np.float32)
        runs[hashed] = w[len(index) : none]
    return Model({a: float(w[i]) for a, i in index.items() if abs(w[i]) > 1e-3}, runs, step, short)


def abbreviations(units: DataFrame, least_share: float = LEAST_SHARE) -> frozenset[str]:
    """Words whose stop belongs to the word, counted over all delivered units: of the stops behind the word, a part
    significantly above two thirds (lower end of Wilson's interval, one standard deviation) stands inside units. Where
    a unit was cut wrongly this is evened out. A word has at least `least_share` of all stops, which bounds their number."""
    word = r"([\p{L}](?:[\p{L}\p{M}.'’\-]*[\p{L}\p{M}])?)\."
    text = F.lower(F.col("text"))
    inside = F.transform(F.regexp_extract_all(text, F.lit(word + r"(?=[\s ]*[^\s ])"), F.lit(1)), lambda w: F.struct(w.alias("w"), F.lit(1).alias("i"), F.lit(0).alias("e")))
    end = F.transform(F.regexp_extract_all(text, F.lit(word + r"(?=[^\p{L}\p{N}]*$)"), F.lit(1)), lambda w: F.struct(w.alias("w"), F.lit(0).alias("i"), F.lit(1).alias("e")))
    known = units.filter("text is not null")
    stops = known.agg(F.sum(F.length("text") - F.length(F.replace(F.col("text"), F.lit("."))))).first()[0] or 0
    c = known.select(F.explode(F.concat(inside, end)).alias("x")).groupBy("x.w").agg(F.sum("x.i").alias("i"), F.sum("x.e").alias("e"))
    low = "(i + 0.5D - sqrt(i * e / (i + e) + 0.25D)) / (i + e + 1)"
    return frozenset(r[0] for r in c.filter(f"i >= {max(1.0, least_share * stops)!r} and {low} > 2D / 3").collect())


_ASIDE = re.compile(r"\([^()\n]{1,40}\)|\[[^\[\]\n]{1,40}\]|\{[^{}\n]{1,40}\}")


def corpus_asides(texts: DataFrame, most: int = ASIDE_TEXTS) -> list[str]:
    """What stands in brackets inside the texts of a hash sample of at most `most`, each once. texts: (text)."""
    rows = hash_sample(texts.filter(F.col("text").rlike(r"[(\[{]")), "text", most).collect()
    return sorted({m.group(0) for (t,) in rows for m in _ASIDE.finditer(t)})


def training_units(refs: DataFrame, units: DataFrame, most: int = TRAIN_UNITS) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """(language, unit) of reference sentences, and of a hash sample of at most `most` delivered units. The language of
    a delivered unit is the one whose reference sentences share most of its words (or character pairs); it only
    decides which units are joined with which."""
    whole: list[tuple[str, str]] = []
    out: list[tuple[str, str]] = []
    words: dict[str, dict[str, int]] = {}

    def bits(t: str) -> list[str]:
        t = t.lower()
        return re.findall(r"[^\W\d_]{2,}", t) + [t[i : i + 2] for i in range(len(t) - 1)]

    known = refs.select("sonar_lang", "text").filter(f"text is not null and sonar_lang is not null and length(text) < {TRAIN_CHARS}")
    for lang, text in sorted(hash_sample(known, "text", TRAIN_REFS).collect()):
        whole.append((lang, text))
        for b in set(bits(text)):
            words.setdefault(b, {}).setdefault(lang, 0)
            words[b][lang] += 1
    for (text,) in sorted(hash_sample(units.select("text").filter(f"text is not null and length(text) < {TRAIN_CHARS}"), "text", most).collect()):
        vote: dict[str, float] = {}
        for b in set(bits(text)):
            if b in words:
                total = sum(words[b].values())
                for lang, c in words[b].items():
                    vote[lang] = vote.get(lang, 0.0) + c / total
        out.append((max(sorted(vote), key=vote.get) if vote else _pool(text), text))
    return whole, out


_made: dict[str, Model] = {}


def splitter(refs: DataFrame, delivered: DataFrame, texts: DataFrame) -> Model:
    """The model for a corpus: reference sentences, delivered units and, for asides, texts. One that was made from the
    same training data before is used again."""
    (whole, units), short, asides = training_units(refs, delivered), abbreviations(delivered), corpus_asides(texts.select("text"))
    key = hashlib.sha256(repr((whole, units, sorted(short), asides)).encode("utf-8", "surrogatepass")).hexdigest()
    if key not in _made:
        if len(_made) > 3:
            _made.clear()
        _made[key] = train(units, short=short, asides=asides, whole=whole)
    return _made[key]


def split_units(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, unit INT, start_at INT, unit_text STRING): one row per unit, with its place in the text."""
    shared = df.sparkSession.sparkContext.broadcast((model.weights, model.runs, model.step, model.short))

    def run(b: pa.RecordBatch) -> pa.RecordBatch | None:
        m = Model(*shared.value)
        ids, unit, start, texts = [], [], [], []
        for r, text in enumerate(b.column(1).to_pylist()):
            at = m.begins(text)
            for k, i in enumerate(at):
                ids.append(r)
                unit.append(k)
                start.append(i)
                texts.append(text[i : at[k + 1] if k + 1 < len(at) else len(text)].rstrip())
        if not ids:
            return None
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int64())), pa.array(unit, pa.int32()), pa.array(start, pa.int32()), pa.array(texts, pa.string())], [id_col, "unit", "start_at", "unit_text"])

    return map_arrow(spread(pick(df, **{"id": id_col, "text": text_col})), run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, unit int, start_at int, unit_text string")
