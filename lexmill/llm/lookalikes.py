"""Problem 10: one form for texts that look the same but differ in their characters.

The characters of a whole Arrow batch are one numpy array of code points. Lookup tables over all code points say
how many characters each becomes and where they stand in a pool: compatibility forms of the same look (full width,
ligatures, presentation forms, radicals) and look-alike letters become their plain letter, accented letters their
letter and marks, characters without ink disappear, every space becomes U+0020. Marks are then put in canonical order
and composed with their letter by table look-ups over the whole array. No string function runs per row.

Letters that merely resemble others in one font (y with Cyrillic u, superscripts, ordinal signs, fractions) keep
their identity, as do case, accents, digits, punctuation and line breaks.

Cases: a null text has a null form; an empty text an empty one; texts of any length are handled whole; repeated rows
have equal forms; other columns are ignored.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import code_points, cut, map_arrow, null_mask, pick, slices, spread, to_strings

#: Letters of other scripts drawn like a Latin letter.
CYRILLIC_LIKE, CYRILLIC_LATIN = "АВЕЅІЈКМНОРСТХаеѕіјорсухԁһԛԝӀԌԚԜѴ", "ABESIJKMHOPCTXaesijopcyxdhqwIGQWV"
GREEK_LIKE, GREEK_LATIN = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲϹϳͿ", "ABEZHIKMNOPTYXovcCjJ"
ARMENIAN_LIKE, ARMENIAN_LATIN = "ՕՍօսցզհոյԼ", "OUougqhnjL"
CHEROKEE_LIKE, CHEROKEE_LATIN = "ᎠᎡᎢᎩᎪᎫᎬᎳᎷᎻᎽᏀᏃᏎᏒᏔᏕᏙᏚᏞᏟᏢᏦᏧᏳᏴ", "DRTYAJEWMHYGZ4RWSVSLCPKdGB"
LISU_LIKE, LISU_LATIN = "ꓐꓑꓒꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPdDTGKJCZFMNLSRVHWXYAEIOU"
PHONETIC_LIKE, PHONETIC_LATIN = "ɡɑᴏᴄᴠᴡᴢ", "gaocvwz"
#: Hyphens drawn like the one of ASCII.
HYPHENS = "\u2010\u2011"
ALIKE = dict(zip(CYRILLIC_LIKE + GREEK_LIKE + ARMENIAN_LIKE + CHEROKEE_LIKE + LISU_LIKE + PHONETIC_LIKE + HYPHENS, CYRILLIC_LATIN + GREEK_LATIN + ARMENIAN_LATIN + CHEROKEE_LATIN + LISU_LATIN + PHONETIC_LATIN + "--"))
#: keys the rows of one text are spread over
SALTS = 8
#: Compatibility forms that do not look like what they stand for.
OTHER_LOOK = ("<super>", "<sub>", "<fraction>", "<circle>", "<square>")

_tables: dict[str, np.ndarray] = {}


def _invisible(c: int) -> bool:
    """Characters without ink: zero-width signs, soft hyphen, joiners, marks of direction, variation selectors."""
    return unicodedata.category(chr(c)) == "Cf" and c not in (0x600, 0x601, 0x602, 0x603, 0x604, 0x605, 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD) or c == 0x34F or 0xFE00 <= c <= 0xFE0F or 0xE0100 <= c <= 0xE01EF or c in (0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0)


def tables() -> dict[str, np.ndarray]:
    """Built once per Python worker from the Unicode data of the interpreter."""
    if _tables:
        return _tables
    alike = ALIKE
    top = 0x110000
    size, start = np.ones(top, np.int8), np.zeros(top, np.int32)
    first, ccc = np.arange(top, dtype=np.uint32), np.zeros(top, np.uint8)
    pool: list[int] = []
    pairs: dict[int, int] = {}

    def parts(ch: str) -> str:
        how = unicodedata.decomposition(ch)
        if not how or how.startswith(OTHER_LOOK):
            return alike.get(ch, ch)
        hexes = how.split()
        return "".join(parts(chr(int(x, 16))) for x in hexes[hexes[0][0] == "<" :])

    for lo, hi in ((0xA0, 0xAC00), (0xD7A4, 0xD800), (0xE000, 0x32000), (0xE0000, 0xE0200)):
        for c in range(lo, hi):
            ch = chr(c)
            if (k := unicodedata.combining(ch)) != 0:
                ccc[c] = k
            if _invisible(c):
                size[c] = 0
            elif unicodedata.category(ch) == "Zs":
                first[c] = 0x20
            else:
                # a spacing sign is drawn on a space of its own: its decomposition keeps that look
                new = parts(ch)
                if new != ch:
                    if len(new) == 1:
                        first[c] = ord(new)
                    else:
                        size[c], start[c] = len(new), len(pool)
                        pool.extend(map(ord, new))
                how = unicodedata.decomposition(ch)
                if how and how[0] != "<" and " " in how and unicodedata.normalize("NFC", ch) == ch:
                    a, b = (int(x, 16) for x in how.split())
                    pairs[int(a) << 32 | b] = c
    keys = np.array(sorted(pairs), np.int64)
    _tables.update(size=size, start=start, first=first, ccc=ccc, pool=np.array(pool or [0], np.uint32), keys=keys, made=np.array([pairs[k] for k in keys.tolist()], np.uint32))
    return _tables


def _compose(cps: np.ndarray, row: np.ndarray, t: dict[str, np.ndarray]) -> np.ndarray:
    """Compose letters with their marks in place; the mask of characters that remain is returned."""
    keep = np.ones(len(cps), bool)
    ccc = t["ccc"]
    while True:
        live = np.flatnonzero(keep)
        c, r = cps[live], row[live]
        k = ccc[c]
        hit = False
        mark = np.flatnonzero((k > 0) | ((c >= 0x1161) & (c <= 0x11C2)))
        mark = mark[mark > 0]
        if not len(mark):
            return keep
        # the letter each mark belongs to: the last character before it that is no mark
        base = np.maximum.accumulate(np.where(k == 0, np.arange(len(c)), -1))
        own = np.where(k[mark] > 0, base[mark], mark - 1)
        ok = (own >= 0) & (r[np.maximum(own, 0)] == r[mark])
        # a mark is blocked by one between it and the letter whose class is not lower
        ok &= (own == mark - 1) | ((k[mark - 1] < k[mark]) & (k[mark - 1] > 0))
        mark, own = mark[ok], own[ok]
        if len(mark):
            key = c[own].astype(np.int64) << 32 | c[mark]
            at = np.minimum(np.searchsorted(t["keys"], key), len(t["keys"]) - 1)
            good = t["keys"][at] == key
            new = t["made"][at]
            lv = (c[own] >= 0x1100) & (c[own] < 0x1113) & (c[mark] >= 0x1161) & (c[mark] < 0x1176)
            lvt = (c[own] >= 0xAC00) & (c[own] < 0xD7A4) & ((c[own] - 0xAC00) % 28 == 0) & (c[mark] > 0x11A7) & (c[mark] < 0x11C3)
            new = np.where(lv, 0xAC00 + ((c[own] - 0x1100) * 21 + c[mark] - 0x1161) * 28, np.where(lvt, c[own] + c[mark] - 0x11A7, new)).astype(np.uint32)
            good |= lv | lvt
            mark, own, new = mark[good], own[good], new[good]
            if len(mark):
                own, one = np.unique(own, return_index=True)  # one mark a letter and round, the first
                cps[live[own]] = new[one]
                keep[live[mark[one]]] = False
                hit = True
        if not hit:
            return keep


def one_form(cps: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The form of all rows at once: code points and row offsets in, the same out."""
    t = tables()
    n_rows = len(offsets) - 1
    row = np.repeat(np.arange(n_rows), np.diff(offsets))
    size = t["size"][cps].astype(np.int64)
    total = int(size.sum())
    src = np.repeat(np.arange(len(cps)), size)
    within = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
    old = cps[src]
    many = t["size"][old] > 1
    out = t["first"][old]
    out[many] = t["pool"][t["start"][old[many]] + within[many]]
    row = row[src]
    # canonical order of marks: a stable sort by class within each run of marks
    k = t["ccc"][out]
    is_mark = k > 0
    if is_mark.any():
        at = np.flatnonzero(is_mark)
        run = np.cumsum(~is_mark)[at]
        order = np.lexsort((k[at], run, row[at]))
        out[at] = out[at[order]]
        keep = _compose(out, row, t)
        out, row = out[keep], row[keep]
    elif ((out >= 0x1161) & (out <= 0x11C2)).any():
        keep = _compose(out, row, t)
        out, row = out[keep], row[keep]
    new_off = np.zeros(n_rows + 1, np.int64)
    np.cumsum(np.bincount(row, minlength=n_rows), out=new_off[1:])
    return out, new_off


def one_form_array(texts: pa.Array) -> pa.Array:
    done = []
    for lo, hi in slices(texts):
        part = texts.slice(lo, hi - lo)
        out, new = one_form(*code_points(part))
        done.append(to_strings(out, new, null_mask(part)))
    return pa.concat_arrays(done) if done else pa.array([], pa.string())


def look_forms(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, form STRING): the one form of each text. A map without a shuffle."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), one_form_array(b.column(1))], [id_col, "form"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_arrow(spread(pick(df, **{"id": id_col, "text": text_col})), run, f"`{id_col}` {kind}, form string")


def look_keys(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, look BINARY, own BINARY): 128-bit digests of the form and of the text as it stands; blank texts are left out.

    Forms are made by the batch and digested in the JVM; only digests are shuffled, some 40 bytes a row, whatever the
    texts' lengths.
    """

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), one_form_array(b.column(1))], [id_col, "__text", "__form"])

    kind = df.schema[id_col].dataType.simpleString()
    made = map_arrow(spread(pick(df, **{"id": id_col, "text": text_col})), run, f"`{id_col}` {kind}, __text string, __form string")
    digest = lambda c: F.unhex(F.md5(F.encode(c, "UTF-8")))
    return made.filter(F.col("__form").rlike(r"[^\s\x{1C}-\x{1F}\x{85}\x{2028}\x{2029}]")).select(id_col, digest(F.col("__form")).alias("look"), digest(F.col("__text")).alias("own"))


def look_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id, n_docs, n_texts): for each text that is not blank, the least id of the texts that look like it,
    how many rows look so and in how many different spellings.

    Rows are first counted by (form, text), so copies of one text, however many, are one row of the second step.
    """
    keys = look_keys(df, id_col, text_col)
    per_text = keys.groupBy("look", "own").agg(F.min(id_col).alias("lo"), F.count("*").alias("n"))
    per_look = per_text.groupBy("look").agg(F.min("lo").alias("class_id"), F.sum("n").alias("n_docs"), F.count("*").alias("n_texts"))
    return keys.join(per_look, "look").select(id_col, "class_id", "n_docs", "n_texts")


def look_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b), a < b: rows that look the same and are not equal.

    Different texts of one form are paired first, each once, however many rows hold it; then each text of a pair is
    replaced by its rows. No rows are joined that are not a result, so copies of one text cost nothing until they meet
    another one. Rows of a text are spread over SALTS keys in both joins.
    """
    keys = cut(look_keys(df, id_col, text_col))  # read three times, made once
    texts = keys.groupBy("look", "own").agg(F.count("*").alias("n"))
    mixed = texts.groupBy("look").agg(F.count("*").alias("n_texts")).filter("n_texts > 1").select("look")
    texts = texts.join(mixed, "look", "left_semi").select("look", "own")
    pairs = texts.withColumnRenamed("own", "own_x").join(texts.withColumnRenamed("own", "own_y"), "look").filter("own_x < own_y")
    rows = keys.join(mixed, "look", "left_semi").withColumn("salt", F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    x = rows.select("look", F.col("own").alias("own_x"), "salt", F.col(id_col).alias("x"))
    y = rows.select("look", F.col("own").alias("own_y"), "salt", F.col(id_col).alias("y"))
    one = pairs.withColumn("salt", every).join(x, ["look", "own_x", "salt"]).drop("salt", "own_x")
    both = one.withColumn("salt", every).join(y, ["look", "own_y", "salt"])
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a < b")
