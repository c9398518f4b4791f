"""Garbled text from wrong character encoding.

Method: a best-first search from each suspicious token.  States are strings and
bytes; edges encode a string in a character set, decode bytes in one, or
unescape markup.  Visited states are hashed, and a character-plausibility cost
(does each character belong to the language, to its neighbours, to its place in
the word) orders the queue and picks the cheapest reachable text.  A token is
garbled if that text is clearly cheaper than the token itself.

The cost is that of the document's language, guessed from its function words, or a
little more than that of any language at all: capitals, symbols or another script
inside a word, controls, single letters.  So regular text of languages that are
not listed costs too little to be rewritten by another single-byte set, while a
strict UTF-8 reading counts as evidence in every language.  Whatever its own cost,
a token is garbled too if all of it is strict UTF-8 of a plausible, shorter text,
or if it is Cyrillic of one case whose letters are far likelier in the other case
of another Cyrillic set.  The steps that explain most garbled tokens of a document
are tried on the others as well.

A model of characters between their neighbours, counted over all texts, decides
where the letters of the wrong set are regular too: a token with a character that
is rare between its neighbours is read in the other single-byte sets, and the
likeliest reading counts if it gains enough bits, alone or with others of the
document; of several UTF-8 readings the likeliest is taken.
"""

from __future__ import annotations

import functools
import heapq
import html
import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Character sets that occur as what was read and as what was written.
READ_AS = ("cp1252", "latin_1", "cp1250", "cp1251", "cp437", "cp850", "cp852", "cp866", "mac_roman", "koi8_r", "iso8859_2", "iso8859_5", "iso8859_15", "mac_cyrillic", "cp1254", "cp1257", "cp1253")
WRITTEN_AS = ("utf_8", "cp1252", "cp1250", "cp1251", "koi8_r", "cp866", "iso8859_2", "mac_roman", "cp850", "cp852", "cp437", "iso8859_5", "mac_cyrillic")
SINGLE_BYTE = WRITTEN_AS[1:]

# The letters beyond ASCII of each language, and frequent function words.
_LOWER = {"de": "äöüß", "en": "éöï", "es": "áéíóúñü", "fr": "àâæçéèêëîïôœùûüÿ", "pl": "ąćęłńóśźż", "pt": "ãõáàâçéêíóôúü", "ru": "абвгдежзийклмнопрстуфхцчшщъыьэюяё"}
LETTERS = {k: frozenset(v + v.upper().replace("SS", "ẞ")) for k, v in _LOWER.items()}
ANY_LATIN = frozenset().union(*(v for k, v in LETTERS.items() if k != "ru"))
_WORDS = {
    "de": "der die das und ist nicht von den mit dem des ein eine auf für im zu hat sich dass nach durch gegen bei wird war vom um als aus einer es",
    "en": "the of and to in is that was for it with as on by be not which this from at are before has or an shows upon have never had",
    "es": "el la de que y en los del las por con una un para se no al su lo como contra sentido este esta según fue",
    "fr": "le la les de des et en du une un que qui dans par pour pas sur au est ne ce se aux contre cour sens été sont",
    "pl": "w i z na do nie się że jest o od przez po za oraz przeciwko dnia jak strony zgodnie sprawie był dla",
    "pt": "o a os as de que e do da em no na dos das um uma por com não para se ao contra nos termos foi pelo",
    "ru": "в и не на что по с от к о из за суд дело против том как был для было",
}
LONE = frozenset("àáâéêóÀÁÂÉÊÓ")  # letters that are words
NAMES = frozenset("áðéíóúýþæöåøÁÐÉÍÓÚÝÞÆÖÅØŒœ")  # Nordic names and the like, in any language
FUNCTION_WORDS = defaultdict(set)
for _k, _v in _WORDS.items():
    for _w in _v.split():
        FUNCTION_WORDS[_w].add(_k)

OPENING, CLOSING, EITHER = "„«‚‹", "”»’›", "“‘"
RARE_CYRILLIC = "ъщфэцюшжёхйЪЩФЭЦЮШЖЁХЙ"
CURRENCY = "€£₽¥¢"
LIGHT_BOX = frozenset("─│┌┐└┘├┤┬┴┼")
QUIET = frozenset("‰†‡™ƒˆ˜½¼¾³²¹×±÷°µ¶¬¤¦©®√≈∧∨•′″→←")
LOSS = "�"
CONTROLS = frozenset(map(chr, range(0x80, 0xA0))) | {LOSS}
NEAR_SCRIPTS = frozenset(("latin", "cyrillic", "greek"))
EAST_ASIAN = frozenset(("cjk", "hiragana", "katakana", "katakana-hiragana", "hangul"))  # written together


class _Everything:
    def __contains__(self, c: str) -> bool:
        return True


EVERY_LETTER = _Everything()
TOKEN_COST, UTF8_COST, WEAK_COST, WEAK_TOKENS, AGREE_COST = 1.5, 0.9, 0.5, 3, 0.6
MODEL_BITS, RARE_SHARE, RARE_BITS, LIKELY_BITS, GAIN_BITS, ALONE_BITS = 20, 2e-5, 2.0, 3.0, 5.0, 14.0
STEP_COST, SWAP_COST, GOOD_COST, NEUTRAL_COST, LONE_SIGN_COST = 0.1, 0.6, 0.3, 0.25, 0.6
MOST_STEPS, MOST_STATES = 3, 600
CACHE_TOKENS, CACHE_CHARS = 200_000, 1 << 16
#: Letters of Russian text in 100,000, and the log odds from which a token of capitals, or of small letters, is another set's.
RUSSIAN = dict(zip("оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё", (10970, 8450, 8010, 7350, 6700, 6260, 5470, 4730, 4540, 4400, 3490, 3210, 2980, 2810, 2620, 2010, 1900, 1740, 1700, 1650, 1590, 1440, 1210, 970, 940, 730, 640, 480, 360, 320, 260, 40, 40), strict=True))
CAPITALS_ODDS, SMALL_ODDS, NO_START_COST = 4.0, 7.0, 3.0
SWAPPED = (("cp1251", "koi8_r"), ("koi8_r", "cp1251"))


@functools.lru_cache(maxsize=CACHE_CHARS)
def _char_cost(c: str, before: str, after: str, letters: frozenset, lang: str) -> float:
    """How implausible the character beyond ASCII is between its neighbours ('' at the ends)."""
    o = ord(c)
    near = before.isalpha() or after.isalpha()
    if c == LOSS:
        return 6.0
    if 0x80 <= o <= 0x9F:
        return 5.0
    if c.isalpha() and c not in "ªº" and c not in QUIET:
        if 0x400 <= o <= 0x4FF:
            cost = 0.0 if c in LETTERS["ru"] else 3.0
            if any(x.isalpha() and not 0x400 <= ord(x) <= 0x4FF for x in (before, after)):
                cost += 3.0
            if c.isupper() and before.islower():
                cost += 2.0
            return cost + (0.1 if c in RARE_CYRILLIC else 0.0) + (0.0 if lang == "ru" else 1.0)
        if o < 0x250 or c == "ẞ":
            cost = 0.0 if c in letters else (1.5 if c.islower() else 1.0) if c in ANY_LATIN else 2.5
            if c.isupper() and before.islower():
                cost += 3.0
            if lang == "ru":
                cost += 0.5
            if before.isdigit() or after.isdigit() or not near and after != "." and c not in LONE:
                cost += 0.8
            return cost
        return 3.0
    if unicodedata.combining(c):
        return 3.0 if not unicodedata.name(c, "").startswith("COMBINING") else 0.5 if before.isalpha() or unicodedata.combining(before or " ") else 2.0
    if c == "█":
        return 2.0 if near else 0.0
    if c in "﻿​‍️":
        return 0.0
    if c in LIGHT_BOX:
        return 0.6 if all(x in LIGHT_BOX or not x for x in (before, after)) else 3.0
    if 0x2500 <= o <= 0x259F:
        return 3.0
    if c in "   ":
        return 0.0 if before and after else 0.2
    if c == "­":
        return 0.0 if before.isalpha() and after.isalpha() else 1.0
    if c in "’":
        return 0.0 if before else 1.0
    if c in EITHER:
        return 2.0 if before.isalnum() and after.isalnum() else 0.0
    if c in OPENING:
        return 2.0 if before.isalnum() else 0.0
    if c in CLOSING:
        return 2.0 if after.isalnum() else 0.0
    if c in "–—…":
        return 1.5 if before.isalpha() and after.isalpha() else 0.0
    if c == "·":
        return 2.5 if near else 0.0
    if c in "§№":
        return 2.5 if near else 0.0
    if c in "ªº":
        if before.isalpha() and before not in "nNaA" or after.isalpha():
            return 2.5
        return 0.0 if before and before in ".0123456789nNaA" or lang in ("es", "pt") else 1.5
    if c in CURRENCY:
        return 2.5 if near else 0.0
    if c in "¿¡":
        return 2.5 if before.isalnum() or not after else 0.0 if lang == "es" else 1.5
    if c in QUIET:
        if c in "³²" and before == "m" or c == "µ" and after == "m" or c == "°" and after in "CF":
            return 0.0
        return 2.5 if near and c != "¬" else 0.2
    if near and unicodedata.category(c)[0] in "SCN":
        return 2.5
    return 1.5 if o < 0x2700 and unicodedata.category(c)[0] in "SC" else 0.2


@functools.lru_cache(maxsize=CACHE_CHARS)
def _script(c: str) -> str:
    return "latin" if c < "ɐ" else unicodedata.name(c, "?").split(" ")[0].lower()


@functools.lru_cache(maxsize=CACHE_CHARS)
def _odd_char(c: str, before: str, after: str) -> float:
    """``_char_cost`` without a language: every letter is as good as any other of its script."""
    if c.isalpha() and c not in "ªº" and c not in QUIET:
        total = 0.0
        for x in (before, after):
            if x.isalpha() and _script(x) != _script(c) and _script(c) not in EAST_ASIAN:
                total += 3.0
        if c.isupper() and before.islower():
            total += 3.0
        if _script(c) == "latin" and (before.isdigit() or after.isdigit() or not before.isalpha() and not after.isalpha() and after != "." and c not in LONE):
            total += 0.8
        return total
    if unicodedata.combining(c):
        return 0.5 if before.isalpha() and unicodedata.name(c, "").startswith("COMBINING") else 3.0
    if c not in CONTROLS and not before.isalnum() and not after.isalnum() and unicodedata.category(c)[0] in "SP" and not 0x2500 <= ord(c) <= 0x259F:
        return 0.2
    return _char_cost(c, before, after, EVERY_LETTER, "es")


def oddness(token: str, limit: float = math.inf) -> float:
    """How little a token looks like text of any language: characters of several scripts, capitals or symbols within words, controls.

    Adding up ends beyond ``limit``.
    """
    total, last = 0.0, len(token) - 1
    odd = sum("\xbf" < c < "\u0100" for c in token)
    if odd > 2 and 2 * odd > sum(map(str.isalpha, token)):
        total += 2.0
    for i, c in enumerate(token):
        if c > "\x7f":
            total += _odd_char(c, token[i - 1] if i else "", token[i + 1] if i < last else "")
            if total > limit:
                break
        elif c < " ":
            total += 4.0
    return total


def cost(token: str, lang: str, limit: float = math.inf) -> float:
    """Plausibility cost of a token in a language; 0 is fully plausible.  Adding up ends beyond ``limit``."""
    letters = NAMES if lang == "names" else LETTERS.get(lang, ANY_LATIN)
    total, last = 0.0, len(token) - 1
    odd = sum(c > "\xbf" and c < "ɐ" and c not in letters for c in token)
    if odd > 2 and 2 * odd > sum(map(str.isalpha, token)):
        total += 2.0
    for i, c in enumerate(token):
        if c > "\x7f":
            total += _char_cost(c, token[i - 1] if i else "", token[i + 1] if i < last else "", letters, lang)
            if total > limit:
                break
        elif c < " ":
            total += 4.0
    return total


def token_cost(token: str, lang: str, limit: float = math.inf) -> float:
    """The cost in the document's language, or 1 more than in any other one; anything beyond ``limit`` if it is more."""
    own = cost(token, lang, limit)
    return own if own <= 1.0 else min(own, 1.0 + oddness(token, limit))


@functools.cache
def _sloppy(name: str) -> tuple[dict[str, bytes], list[str]]:
    """A single-byte character set with undefined bytes as the control characters of the same number."""
    decode = []
    for b in range(256):
        try:
            decode.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            decode.append(chr(b))
    encode = {c: bytes([b]) for b, c in reversed(list(enumerate(decode)))}
    if name == "cp1252":
        encode |= {chr(b): bytes([b]) for b in range(0x80, 0xA0) if chr(b) not in encode}
    return encode, decode


def _encode(text: str, name: str) -> bytes | None:
    table = _sloppy(name)[0]
    try:
        return b"".join([table[c] for c in text])
    except KeyError:
        return None


def _decode(raw: bytes, name: str) -> str | None:
    if name == "utf_8":
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            return _decode_broken(raw)
    table = _sloppy(name)[1]
    return "".join([table[b] for b in raw])


_BROKEN = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})")


def _decode_broken(raw: bytes) -> str | None:
    """UTF-8 with stray bytes kept as they are lost: only if whole characters prevail."""
    good = sum(map(len, _BROKEN.findall(raw)))
    high = sum(b > 0x7F for b in raw)
    return raw.decode("utf-8", "replace") if good * 3 > high * 2 else None


def _edges(text: str) -> Iterator[tuple[str, str]]:
    """The texts one encode and decode, or one unescape, away; UTF-8 first."""
    if "&" in text and (u := html.unescape(text)) != text:
        yield u, "unescape"
    by_bytes: dict[bytes, str] = {}
    for r in READ_AS:
        if (raw := _encode(text, r)) is not None:
            by_bytes.setdefault(raw, r)
    for w in WRITTEN_AS:
        for raw, r in by_bytes.items():
            if w != r and (s := _decode(raw, w)) is not None:
                yield s, f"{r}>{w}"


@functools.cache
def search(token: str, lang: str) -> tuple[float, str, str]:
    """(cost saved, cheapest reachable text, the steps to it) of a token; (0, token, '') if it stands as it is."""
    if "&" in token and (u := html.unescape(token)) != token:  # markup itself is no fault: judge what it stands for
        saved, fixed, way = search(u, lang)
        return (saved, fixed, f"unescape {way}") if way else (0.0, token, "")
    if LIGHT_BOX.issuperset(token):  # a drawing
        return 0.0, token, ""
    start = token_cost(token, lang)
    best, rest = (start, token, ""), start
    if start < 0.9:
        return 0.0, token, ""
    seen, found = {hash(token)}, False
    queue: list[tuple[float, int, int, str, str]] = [(start, 0, 0, token, "")]
    n = 0
    while queue and n < MOST_STATES and not found:
        at, steps, _, text, way = heapq.heappop(queue)
        if steps >= MOST_STEPS or steps and at >= start + STEP_COST and "unescape" not in way:
            continue
        for s, op in _edges(text):
            if (h := hash(s)) in seen:
                continue
            seen.add(h)
            n += 1
            left = token_cost(s, lang, start)
            if op.endswith(">utf_8") and len(s) < len(text) and LOSS not in s:  # strict sequences are evidence in any language
                left = min(left, oddness(s) + NEUTRAL_COST + NEUTRAL_COST / (len(text) - len(s)) + (LONE_SIGN_COST if any(_script(c) not in NEAR_SCRIPTS for c in s if c.isalpha()) and len(text) - len(s) < 4 else 0.0))
            price = left + STEP_COST * (steps + 1) + (0.0 if "utf_8" in op or op == "unescape" else SWAP_COST)
            done = f"{way} {op}".strip()
            if price < best[0]:
                best, rest = (price, s, done), left
                if price < GOOD_COST or left < STEP_COST and not op.endswith(">utf_8"):  # no later edge is cheaper
                    found = True
                    break
            if left >= start and op != "unescape" and "unescape" not in way:
                continue
            heapq.heappush(queue, (price, steps + 1, n, s, done))
    if not best[2] or rest > 0.4 * start:
        return 0.0, token, ""
    return max(0.0, start - rest), best[1], best[2]


def _shorter_utf8(token: str, lang: str) -> tuple[str, str]:
    """(text, step) of the cheapest strict UTF-8 reading that is no less plausible than the token; ('', '') if there is none."""
    if LIGHT_BOX.issuperset(token):
        return "", ""
    own, best = token_cost(token, lang), (math.inf, "", "")
    for r in READ_AS:
        if (raw := _encode(token, r)) is None:
            continue
        try:
            s = raw.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if len(s) < len(token):
            price = token_cost(s, lang)
            if (price <= own or min(cost(s, k) for k in (*LETTERS, "names")) < own) and price < best[0]:
                best = (price, s, f"{r}>utf_8")
    return best[1:]


def _log_likelihood(word: str) -> float:
    return sum(math.log(RUSSIAN[c] / 1e5) for c in word) - NO_START_COST * (word[0] in "ъьы")


def _swapped_case(token: str, lang: str) -> tuple[str, str]:
    """(text, step) of a Russian token of one case whose letters tell another Cyrillic set; ('', '') if there is none."""
    word = "".join(c for c in token if c.lower() in RUSSIAN)
    if lang != "ru" or not word or not (word.isupper() or word.islower()):
        return "", ""
    own, best = _log_likelihood(word.lower()), (CAPITALS_ODDS if word.isupper() else SMALL_ODDS, "", "")
    for r, w in SWAPPED:
        if (raw := _encode(token, r)) is None:
            continue
        s = _decode(raw, w)
        other = "".join(c for c in s.lower() if c in RUSSIAN)
        if len(other) == len(word) and cost(s, lang) <= cost(token, lang) and (odds := _log_likelihood(other) - own) >= best[0]:
            best = (odds, s, f"{r}>{w}")
    return best[1:]


@functools.cache
def certain(token: str, lang: str) -> tuple[str, str]:
    """(text, steps) of a token that is garbled whatever its cost; ('', '') otherwise."""
    u = html.unescape(token) if "&" in token else token
    if u.isascii():
        return "", ""
    fixed, way = _shorter_utf8(u, lang)
    if not way:
        fixed, way = _swapped_case(u, lang)
    return fixed, f"unescape {way}" if way and u != token else way


def price(token: str, lang: str) -> float:
    """The cheaper of the token's cost in the language and, at a little more, in any."""
    return min(token_cost(token, lang), oddness(token) + 2 * NEUTRAL_COST)


def follow(token: str, way: str) -> str | None:
    """The token after the steps of ``way``; None if they do not apply or lose characters."""
    for op in way.split(" "):
        if op == "unescape":
            token = html.unescape(token)
            continue
        read, written = op.split(">")
        raw = _encode(token, read)
        s = None if raw is None else _decode(raw, written)
        if s is None or LOSS in s:
            return None
        token = s
    return token


def _slots(before: np.ndarray, c: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The model's slot of each character between its neighbours (code points as uint64)."""
    h = before * np.uint64(0x9E3779B1) ^ c * np.uint64(0x85EBCA77) ^ after * np.uint64(0xC2B2AE3D)
    return (h * np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(64 - MODEL_BITS)


def contexts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(place, slot) of every character beyond ASCII; ASCII other than letters counts as a blank beside it."""
    u = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    at = np.flatnonzero(u > 0x7F)
    if not len(at):
        return at, at.astype(np.uint64)
    low = u | np.uint64(32)
    u = np.where((u < 0x80) & ~((low >= 97) & (low <= 122)), np.uint64(32), u)
    return at - 1, _slots(u[at - 1], u[at], u[at + 1])


@functools.cache
def _code_points() -> np.ndarray:
    """(set, byte): the code points of the single-byte sets."""
    return np.array([[ord(c) for c in _sloppy(w)[1]] for w in SINGLE_BYTE], np.uint64)


class Model:
    """``bits``: log2 of one and the count of each slot; ``rare``: up to there a character is rare between its neighbours."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.rare = max(float(np.log2(1 + 2.0 ** bits.max() * RARE_SHARE)), RARE_BITS)
        self.met: dict[str, float] = {}  # by the three characters

    def least(self, token: str) -> float:
        """The least bits of a character beyond ASCII in the token."""
        low, padded = math.inf, f" {token} "
        for i, c in enumerate(token):
            if c > "\x7f":
                three = padded[i : i + 3]
                if (bits := self.met.get(three)) is None:
                    if len(self.met) > CACHE_TOKENS:
                        self.met.clear()
                    place, slots = contexts(f"{three[0]}{c}{three[2]}")
                    bits = self.met[three] = float(self.bits[slots[list(place).index(1)]])
                low = min(low, bits)
        return low


def character_model(df: DataFrame, text: str) -> np.ndarray:
    """log2 of one and the number of times that each character beyond ASCII occurs between its neighbours, over all texts.

    The counts are hashed into 2^``MODEL_BITS`` slots, so the model has one
    size whatever the data; every partition adds its own up before the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << MODEL_BITS, np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                some = [t for t in b.column(0).slice(lo, 500).to_pylist() if t]
                slots = contexts("\n".join(some))[1].astype(np.int64)
                if len(slots):
                    total += np.bincount(slots, minlength=len(total))
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(total[hit])], names=["slot", "n"])

    model = np.zeros(1 << MODEL_BITS, np.float32)
    counts = df.select(text).mapInArrow(run, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()  # at most 2^MODEL_BITS rows
    model[counts["slot"].to_numpy()] = np.log2(1 + counts["n"].to_numpy())
    return model


def learned(token: str, model: Model) -> tuple[float, str, str]:
    """(bits gained, text, step) of the single-byte reading that the model holds likelier by far; (0, token, '') if none.

    Only tokens with a character that is rare between its neighbours are read
    anew.  The gain is the sum of log2 counts over the characters.
    """
    if not model.rare >= model.least(token):
        return 0.0, token, ""
    place, slots = contexts(token)
    raws: dict[bytes, str] = {}
    for r in READ_AS:
        if (raw := _encode(token, r)) is not None:
            raws.setdefault(raw, r)
    if not raws:
        return 0.0, token, ""
    own = np.zeros(len(token), np.float32)
    own[place] = model.bits[slots]
    # every reading at once: (set written in, set read as, character)
    u = _code_points()[:, np.frombuffer(b"".join(raws), np.uint8).reshape(len(raws), -1)]
    low = u | np.uint64(32)
    near = np.where((u < 0x80) & ~((low >= 97) & (low <= 122)), np.uint64(32), u)
    near = np.pad(near, ((0, 0), (0, 0), (1, 1)), constant_values=32)
    bits, beyond = model.bits[_slots(near[..., :-2], u, near[..., 2:])], u > 0x7F
    gain = np.where(beyond, bits - own, 0).sum(-1)
    fair = (np.where(beyond, bits, np.inf).min(-1) >= model.rare + LIKELY_BITS) & (gain >= np.maximum(LIKELY_BITS * beyond.sum(-1), GAIN_BITS)) & beyond.any(-1)
    at = np.argwhere(fair)
    names = list(raws.values())
    for i in np.argsort(-gain[fair], kind="stable"):
        w, r = SINGLE_BYTE[at[i][0]], names[at[i][1]]
        s = "".join(map(chr, u[tuple(at[i])]))
        if w != r and s != token and oddness(s) <= oddness(token) + NEUTRAL_COST:
            return float(gain[tuple(at[i])]), s, f"{r}>{w}"
    return 0.0, token, ""


def likelier_utf8(token: str, fixed: str, way: str, model: Model) -> tuple[str, str]:
    """(text, steps): of several strict UTF-8 readings of a token the one whose characters the model holds likeliest."""
    if way.count(">") != 1 or not way.endswith(">utf_8"):
        return fixed, way
    mean = lambda s: float(model.bits[c[1]].mean()) if len((c := contexts(s))[0]) else 0.0
    best = (mean(fixed) + LIKELY_BITS, fixed, way)
    for r in READ_AS:
        if (raw := _encode(token, r)) is None:
            continue
        try:
            s = raw.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if s != fixed and len(s) < len(token) and (bits := mean(s)) > best[0]:
            best = (bits, s, f"{r}>utf_8")
    return best[1], best[2]


def guess_language(tokens: list[str]) -> str:
    """The language whose function words the tokens hold most; if they hold none, Russian where most are not ASCII, else ''."""
    votes: dict[str, int] = defaultdict(int)
    for w in set(tokens):
        for k in FUNCTION_WORDS.get(w, ()):
            votes[k] += 1
    if votes:
        return max(votes, key=lambda k: (votes[k], k))
    return "ru" if sum(not w.isascii() for w in tokens) * 2 > len(tokens) else ""


_SPACES = re.compile(r"[ \t\r\n]+")
_ENTITY = re.compile(r"&#?\w+;")


def inspect(text: str | None, model: Model | None = None, known: dict | None = None) -> tuple[bool, str | None, int]:
    """(garbled, restored text, tokens changed) of a text; null and plain ASCII texts are not garbled.

    ``known`` keeps what the model said of tokens.
    """
    if not text or text.isascii() and not _ENTITY.search(text):
        return False, text, 0
    tokens = text.replace("\n", " ").replace("\r", " ").replace("\t", " ").split(" ")
    odd = {t for t in tokens if not t.isascii() or "&" in t and _ENTITY.search(t)}
    if not odd:
        return False, text, 0
    lang = guess_language(tokens)
    garbled, fixes, ways = LOSS in text, {}, Counter()
    weak: dict[str, dict] = defaultdict(dict)
    strong: Counter = Counter()
    for t in odd:
        saved, fixed, way = search(t, lang)
        if way and saved >= (UTF8_COST if way.endswith(">utf_8") and fixed and len(fixed) < len(t) else TOKEN_COST):
            garbled = True
            if model is not None:
                fixed, way = likelier_utf8(t, fixed, way, model)
            fixes[t] = fixed
            ways[way] += 1
        elif (sure := certain(t, lang))[1]:
            garbled = True
            fixes[t] = sure[0]
            ways[sure[1]] += 1
        elif way and saved >= WEAK_COST:
            weak[way][t] = fixed
            strong[way] += oddness(t) >= oddness(fixed) + WEAK_COST
    for way, some in weak.items():
        if way in ways or strong[way] >= WEAK_TOKENS:
            garbled = True
            fixes |= some
            ways[way] += len(some)
    if model is not None:
        gains: dict[str, float] = defaultdict(float)
        read: dict[str, dict] = defaultdict(dict)
        for t in odd - fixes.keys():
            if t.isascii():
                continue
            if (said := known.get(t)) is None:
                if len(known) > CACHE_TOKENS:
                    known.clear()
                said = known[t] = learned(t, model)
            if said[2]:
                gains[said[2]] += said[0]
                read[said[2]][t] = said[1]
        for way, some in read.items():
            if way in ways or gains[way] >= ALONE_BITS:
                garbled = True
                fixes |= some
                ways[way] += len(some)
    if fixes:  # what garbled most of the text likely garbled the rest
        way = max(ways, key=lambda w: (ways[w], w))
        for t in odd:
            if (s := follow(t, way)) and s != t and price(s, lang) <= min(price(fixes[t], lang) + AGREE_COST if t in fixes else math.inf, price(t, lang) - WEAK_COST):
                fixes[t] = s
    fixes = {t: s for t, s in fixes.items() if s != t}
    if search.cache_info().currsize > CACHE_TOKENS:
        search.cache_clear()
        certain.cache_clear()
    if not fixes:
        return garbled, text, 0
    parts = re.split(r"([ \t\r\n]+)", text)
    return garbled, "".join([fixes.get(p, p) for p in parts]), len(fixes)


def find_garbled(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, restored, n_restored) of the garbled rows.

    ``restored`` is the whole text with every garbled token replaced by the
    cheapest one reachable; characters lost for good stay as they are.  Null
    and empty texts are not garbled; markup alone is no fault.  Texts are read
    whole, equal rows give equal rows, other columns are left out.  No shuffle.
    """
    kind = df.schema[doc_id].dataType
    shared = df.sparkSession.sparkContext.broadcast(character_model(df, text))  # 2^MODEL_BITS numbers
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("restored", T.StringType()), T.StructField("n_restored", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = Model(shared.value), {}
        for b in batches:
            hits, texts, changed = [], [], []
            for i, t in enumerate(b.column(1)):
                garbled, restored, n = inspect(t.as_py(), model, known)
                if garbled:
                    hits.append(i)
                    texts.append(restored)
                    changed.append(n)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(hits, pa.int64())), pa.array(texts, pa.string()), pa.array(changed, pa.int64())], names=["doc_id", "restored", "n_restored"])

    return df.select(doc_id, text).mapInArrow(run, schema)
