"""Problem 10: garbled text from wrong character encoding, by round-trip repair.

A line is re-encoded under each candidate legacy encoding and strictly decoded
as each intended one; the cheapest reading under a garbling cost replaces it
if the cost drops, and the search starts again on the result, for nested
layers.  Where a line mixes sound and garbled characters, its runs of
non-ASCII characters are tried one by one.  A reading in a single-byte encoding,
which nearly any text allows, must also turn pairs of neighbouring letters that
sound text doesn't have into pairs that it has: pairs are counted over all lines
of the collection that no garbling can have left, beside those of a few
sentences (SAMPLES).  What stays beyond repair (replacement and control
characters, several words of accented letters only) still counts as damage.

Defined results: null and empty texts are sound; text lost to replacement
characters is reported without a restored text; text of one sound encoding
comes back unchanged, so the operator is idempotent.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Encodings that text is often decoded in by mistake, and those it is often written in.
LEGACY = ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251", "koi8_r", "cp866")
INTENDED_SINGLE = ("cp1251", "koi8_r", "cp866", "cp1252", "mac_roman")
LAYERS = 4
#: Share of usual letter pairs that a single-byte rereading must reach, and by how much it must gain; rows that make a pair usual.
USUAL, GAIN, SEEN = 0.7, 0.3, 3
#: Characters that sound text has.
TYPOGRAPHIC = "“”‘’„–—…€°×→←≥≤≠≈∞«»¿¡§•±·№"
COMMON_RUSSIAN = "оеаинтсрвлкмдпу"
RARE_RUSSIAN = "шюцщэфъёйхжч"


class _Bytes(dict):
    """Characters to the bytes a legacy encoding has for them, as code points below 256; others to a character outside."""

    def __init__(self, encoding: str):
        super().__init__()
        for b in range(256):
            try:
                c = bytes([b]).decode(encoding)
            except UnicodeDecodeError:
                c = chr(b)
            self[ord(c)] = b

    def __missing__(self, key: int) -> int:
        return 0x100


_bytes = {e: _Bytes(e) for e in LEGACY}


def _pairs() -> str:
    """Leading and continuing bytes of UTF-8 as each legacy encoding shows them; box and block characters stand for themselves."""
    parts = []
    for e in LEGACY:
        chars = {b: chr(o) for o, b in _bytes[e].items()}
        leads = range(0xC2, 0xE0) if e in ("cp437", "cp850", "cp866") else range(0xC2, 0xF5)
        lead, cont = ("".join(re.escape(chars[b]) for b in r if b in chars) for r in (leads, range(0x80, 0xC0)))
        parts.append(f"[{lead}][{cont}]")
    return "|".join(parts)


#: A line without any of these has no UTF-8 to read back, and none of these no other encoding.
_PAIRED = re.compile("[\u0080-\u009f]|[─-◿]|" + _pairs())
_SWAPPED = re.compile("[\u0080-\u009f�]|[À-ÖØ-öø-ÿ]{3}|[ЀЂ-Џѐђ-ӿ]|[А-ЯЁ]{3}|[а-яё][А-ЯЁ]|[A-Za-z][Ѐ-ӿ]|[Ѐ-ӿ][A-Za-z]")
_RUN = re.compile("[^\x00-\x7f]+")
_MIXED = re.compile(r"[A-Za-zÀ-ÿ][Ѐ-ӿ]|[Ѐ-ӿ][A-Za-zÀ-ÿ]")
_HARD = re.compile("[\u0080-\u009f�]")
#: Sound sentences, for collections that have none of a language.
SAMPLES = (
    "Für jede Prüfung müssen die Wörter über größere Maßstäbe zurückgeführt werden, während schöne Bücher später höchstens erwähnt würden. Übrigens hätten Köche ähnliche Gründe.",
    "L'été dernier, la fenêtre était déjà cassée à côté de l'hôtel où les élèves préparaient leur thèse; ça n'a pas été très gênant, grâce à la maîtresse. Où êtes-vous née?",
    "¿Qué ocurrió después? El niño también comió más jamón según la canción; el árbol pequeño está aquí, y además la razón es fácil. Sólo él lo sabía: mañana habrá música.",
    "A função não é válida: há três razões para a solução já não estar aqui, também às vezes ninguém vê os órgãos e as posições. Você não põe açúcar no café da manhã, pois são opções úteis.",
    "После проверки каждая строка сохраняется в памяти, чтобы можно было быстро найти нужное значение и вернуть ответ. Если число больше предыдущего, функция должна пропустить его и продолжить работу; эта ошибка возникает из-за неверного условия. Объём данных ещё растёт, поэтому мы считаем только последние шаги цикла. Например, жёлтый флаг съехал вниз, а юный художник щедро выбрал другой цвет.",
    "Учитель проверил домашние задания и сказал, что большинство учеников справились хорошо; некоторые упражнения всё же пришлось исправлять дважды. Вечером они вышли из дома, прошли вдоль реки до старого моста и долго обсуждали увиденное. В городе давно не было такой тёплой осени: дети играли во дворе, соседи сидели на скамейке, а над крышами медленно поднимался белый дым. Завтра утром поезд отправится на север, и путешественники наконец увидят большие озёра, тихие леса и высокие горы.",
)


def _weight(c: str) -> float:
    o = ord(c)
    if c in TYPOGRAPHIC:
        return 1.0
    if o == 0xFFFD or 0x80 <= o < 0xA0:
        return 8.0
    if 0xC0 <= o < 0x100 and o not in (0xD7, 0xF7):
        return 1.0
    if 0x410 <= o <= 0x44F or o in (0x401, 0x451):
        low = c.lower()
        return (0.6 if low in COMMON_RUSSIAN else 1.6 if low in RARE_RUSSIAN else 1.0) + (0.3 if c != low else 0)
    if 0xA0 <= o < 0xC0:
        return 3.0
    if c in "œŒšŠžŽŸ":
        return 2.0
    return 4.0 if not 0x2500 <= o < 0x2600 else 5.0


_LOST = re.compile(rb"\xd0(?![\x80-\xbf])")
_weights: dict[str, float] = {}
_LONG_LATIN = re.compile(r"[À-ÖØ-öø-ÿ]{3,}")
_CASE = re.compile(r"[а-яё][А-ЯЁ]")


def cost(text: str) -> float:
    """Garbling cost: low for what sound text has, high for what wrong decoding leaves."""
    total = 0.0
    for run in _RUN.findall(text):
        for c in run:
            w = _weights.get(c)
            if w is None:
                w = _weights[c] = _weight(c)
            total += w
    total += sum(2.0 * (len(m) - 2) for m in _LONG_LATIN.findall(text))
    return total + 2.0 * len(_CASE.findall(text)) + 3.0 * len(_MIXED.findall(text))


def _reread(text: str, legacy: str, intended: str) -> str | None:
    try:
        raw = text.translate(_bytes[legacy]).encode("latin-1")
        return raw.decode(intended)
    except UnicodeEncodeError:
        return None
    except UnicodeDecodeError:
        if (legacy, intended) != ("cp1251", "utf-8"):
            return None
    try:  # 0x98 has no character there and is often lost; after 0xD0 nothing else can be missing
        return _LOST.sub(b"\xd0\x98", raw).decode(intended)
    except UnicodeDecodeError:
        return None


def letter_pairs(text: str) -> list[str]:
    """Pairs of neighbouring characters with a letter beyond ASCII among them, in lower case; blanks and signs count as the end of a word."""
    low = "".join(c if c.isalpha() else " " for c in text.lower())
    return [a + b for a, b in zip(" " + low, low + " ") if not (a.isascii() and b.isascii())]


_PRIOR = frozenset(p for s in SAMPLES for p in letter_pairs(s))


def usual(text: str, known: frozenset | set) -> float:
    """The share of a text's letter pairs that sound text has; 0 without any."""
    pairs = letter_pairs(text)
    return sum(p in known for p in pairs) / len(pairs) if pairs else 0.0


def _best(text: str, now: float, paired: bool, swapped: bool, known: frozenset | set) -> tuple[str, float]:
    best, least = text, now
    have = None
    for legacy in LEGACY:
        for intended in (*(("utf-8",) if paired else ()), *(INTENDED_SINGLE if swapped else ())):
            if legacy == intended:
                continue
            other = _reread(text, legacy, intended)
            if other is None or other == text:
                continue
            c = cost(other)
            # a single-byte rereading keeps the length, so it must convince by more
            if c < least and (intended == "utf-8" or c < 0.7 * now):
                if intended != "utf-8":
                    have = usual(text, known) if have is None else have
                    will = usual(other, known)
                    # where only signs change, or a strange letter within a word of another script becomes one, there are no letters to judge by
                    pairs = letter_pairs(other)
                    sign = not pairs and have == 0 and _MIXED.search(text)
                    if pairs != letter_pairs(text) and not sign and (len(pairs) < 4 or will < USUAL or will < have + GAIN):
                        continue
                best, least = other, c
    return best, least


def _runs(text: str) -> str:
    def one(m: re.Match) -> str:
        run = m.group()
        if len(run) < 2:
            return run
        now, best = cost(run), run
        least = now
        for legacy in LEGACY:
            other = _reread(run, legacy, "utf-8")
            if other is not None and other != run and (c := cost(other)) < least:
                best, least = other, c
        return best

    return _RUN.sub(one, text)


def repair_line(line: str, known: frozenset | set = _PRIOR) -> tuple[str, int, bool]:
    """The restored line, the layers undone, and whether damage is left."""
    layers = 0
    if line.isascii():
        return line, 0, False
    while layers < LAYERS:
        paired, swapped = bool(_PAIRED.search(line)), bool(_SWAPPED.search(line))
        if not paired and not swapped:
            break
        new, _ = _best(line, cost(line), paired, swapped, known)
        if new == line and paired:
            new = _runs(line)
        if new == line:
            break
        line, layers = new, layers + 1
    return line, layers, bool(_HARD.search(line)) or sum(len(m) >= 4 and m[1:].islower() for m in _LONG_LATIN.findall(line)) >= 3


def repair(text: str | None, known: frozenset | set = _PRIOR) -> tuple[str | None, int, bool]:
    """As ``repair_line``, of a whole text."""
    if not text or text.isascii():
        return text, 0, False
    out = [repair_line(line, known) for line in text.split("\n")]
    return "\n".join(x[0] for x in out), max(x[1] for x in out), any(x[2] for x in out)


_REPERTOIRE = frozenset(c for e in (*LEGACY, *INTENDED_SINGLE) for b in range(128, 256) for c in bytes([b]).decode(e, "ignore").lower() if c.isalpha()) | frozenset("abcdefghijklmnopqrstuvwxyz ")


def sound_pairs(texts: DataFrame) -> frozenset:
    """The letter pairs of SEEN rows and more of (text), over all lines that show no trace of garbling.  They are pairs of the encodings' letters, so their number is bounded."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n: Counter = Counter()
            for t in pdf["text"]:
                seen: set = set()
                for line in t.split("\n"):
                    if not (line.isascii() or _PAIRED.search(line) or _SWAPPED.search(line)):
                        seen.update(letter_pairs(line))
                n.update(p for p in seen if p[0] in _REPERTOIRE and p[1] in _REPERTOIRE)
            yield pd.DataFrame({"pair": pd.Series(list(n), dtype=object), "n": pd.Series(list(n.values()), dtype="int64")})

    rows = texts.mapInPandas(run, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") >= SEEN)
    return _PRIOR | {r[0] for r in rows.select("pair").collect()}  # at most the square of the repertoire


def find_garbled(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, layers, complete, restored): one row per damaged text; ``restored`` is null where nothing could be restored."""

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("text").rlike("[^\\x00-\\x7f]"))
    known = df.sparkSession.sparkContext.broadcast(sound_pairs(rows.select("text")))  # bounded by the encodings

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs = known.value
        for pdf in batches:
            rows = []
            for k, t in zip(pdf["key"], pdf["text"]):
                new, layers, left = repair(t, pairs)
                if layers or left:
                    rows.append((k, layers, not left, new if layers else None))
            yield pd.DataFrame(rows, columns=["key", "layers", "complete", "restored"])

    kind = dict(df.select(F.col(key).alias("key")).dtypes)["key"]
    return rows.mapInPandas(run, f"key {kind}, layers int, complete boolean, restored string")
