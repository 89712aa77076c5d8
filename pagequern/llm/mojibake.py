"""Garbled text from wrong character encoding (problem 1).

Adjacent characters are scored by the mutual information of their kinds over the whole corpus (counted per
partition in numpy, summed into a table of fixed size): pairs seen less often than their parts would meet by
chance are improbable. Maximum-scoring segments isolate the improbable runs, extended to the foreign
characters they touch. Inverse mappings are tested only inside those runs: bytes in each encoding the text
may have been read with, read again as UTF-8 (up to three times over) or, for runs that are no UTF-8, as
another single-byte or East Asian encoding. The latter must make the run's character pairs more probable by
the corpus counts. Replacement characters are damage that can't be undone.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequern.session import table

PAIR_BITS = 18
#: A segment of improbable pairs counts from this score on; probable pairs weigh at most LEAST.
SEGMENT, LEAST = 0.3, -1.5
#: In a field known to be damaged, any other pair of foreign characters is improbable by so much more.
DAMAGED = 1.3
#: A reading is clear if its log-probability is so much higher than any other's, per character in which they differ.
CLEAR = 0.5
#: A reading in another single-byte encoding must gain this much log-probability per changed character.
GAIN = 1.6

READ_AS = ("cp1252", "latin_1", "cp1250", "iso8859_2", "cp1251", "mac_roman", "cp437", "cp850", "cp852", "koi8_r", "cp866", "cp1254", "cp1253", "iso8859_15", "iso8859_5", "iso8859_9", "mac_latin2", "mac_cyrillic", "cp1257", "cp1258")
EAST = ("euc_jp", "gbk", "cp932", "cp949", "big5")
MEANT = ("cp1252", "cp1250", "iso8859_2", "cp1251", "koi8_r", "cp866", "iso8859_5", "mac_roman", "mac_cyrillic")
_UTF8 = re.compile(rb"[\xC2-\xDF][\x80-\xBF]|\xE0[\xA0-\xBF][\x80-\xBF]|[\xE1-\xEC\xEE\xEF][\x80-\xBF]{2}|\xED[\x80-\x9F][\x80-\xBF]|\xF0[\x90-\xBF][\x80-\xBF]{2}|[\xF1-\xF3][\x80-\xBF]{3}|\xF4[\x80-\x8F][\x80-\xBF]{2}")
_QUOTED = re.compile(r"`[^`\n]{1,40}`")
_ENTITY = re.compile(r"&#(1[2-9]\d|[2-9]\d\d|[1-9]\d{3}|[1-4]\d{4}|5[0-4]\d{3});")
#: A lone replacement character that a text speaks of.
_MENTIONED = re.compile(r"(?i)\b(?:character|symbol|sign|caractère|carácter|caractere|zeichen|znak|символ|文字)s? ?[\"'(«„“]?�(?!�)")

_KINDS = "blank lower upper digit punct accent_lower accent_upper ext_lower ext_upper latin_symbol control general_punct currency greek cyrillic_lower cyrillic_upper cyrillic_rare kana han fullwidth box math combining other replacement letterlike".split()
_K = {k: i for i, k in enumerate(_KINDS)}
_RUSSIAN = set("абвгдежзийклмнопрстуфхцчшщъыьэюяё")


def _kind(c: int) -> str:
    x = chr(c)
    if c < 128:
        return "blank" if x in " \n\t\r" else "lower" if "a" <= x <= "z" else "upper" if "A" <= x <= "Z" else "digit" if x.isdigit() else "punct" if c >= 32 else "control"
    if c < 160:
        return "control"
    if c < 256:
        return "latin_symbol" if not x.isalpha() or x in "ªº" else "accent_lower" if x.islower() else "accent_upper"
    if c < 0x250 or 0x1E00 <= c < 0x1F00:
        return "ext_lower" if x.islower() else "ext_upper"
    if c == 0xFFFD:
        return "replacement"
    if 0x300 <= c < 0x370:
        return "combining"
    if 0x370 <= c < 0x400:
        return "greek"
    if 0x400 <= c < 0x530:
        return "cyrillic_rare" if x.lower() not in _RUSSIAN else "cyrillic_lower" if x.islower() else "cyrillic_upper"
    if 0x2000 <= c < 0x2070 or 0x3000 <= c < 0x3040:
        return "general_punct"
    if 0x20A0 <= c < 0x20D0:
        return "currency"
    if 0x2100 <= c < 0x2190:
        return "letterlike"
    if 0x2200 <= c < 0x2400:
        return "math"
    if 0x2500 <= c < 0x2600:
        return "box"
    if 0x3040 <= c < 0x3100:
        return "kana"
    if 0x3400 <= c < 0xA000:
        return "han"
    if 0xFF00 <= c < 0xFFF0:
        return "fullwidth"
    return "other"


_CLASS = np.array([_K[_kind(c)] if not 0xD800 <= c < 0xE000 else _K["other"] for c in range(65536)], np.uint8)
_N = len(_KINDS)


_ALIEN = np.zeros(_N, bool)
_ALIEN[[_K[k] for k in ("accent_upper", "ext_upper", "latin_symbol", "control", "currency", "box", "math", "cyrillic_rare", "letterlike", "greek", "general_punct")]] = True
_LETTER = np.zeros(_N, bool)
_LETTER[[_K[k] for k in ("lower", "upper", "accent_lower", "accent_upper", "ext_lower", "ext_upper", "cyrillic_lower", "cyrillic_upper")]] = True
#: Characters of these kinds by themselves are no sign of another single-byte encoding.
_WEAK = {_K["general_punct"], _K["currency"], _K["kana"], _K["han"], _K["fullwidth"], _K["replacement"]}


def _codes(text: str) -> np.ndarray:
    return np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 65535)


def _pair_slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a.astype(np.uint32) * np.uint32(0x9E3779B1)) ^ (b.astype(np.uint32) * np.uint32(0x85EBCA6B))
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0xC2B2AE35)
    return (h >> np.uint32(32 - PAIR_BITS)).astype(np.int64)


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = np.zeros(_N * _N, np.int64)
    pairs = np.zeros(1 << PAIR_BITS, np.int64)
    for batch in batches:
        joined = "\n".join(t for name in batch.schema.names for t in batch.column(name).to_pylist() if t)
        if len(joined) < 2:
            continue
        codes = _codes(joined)
        k = _CLASS[codes].astype(np.int64)
        kinds += np.bincount(k[:-1] * _N + k[1:], minlength=_N * _N)
        foreign = np.flatnonzero((codes[:-1] > 127) | (codes[1:] > 127))
        pairs += np.bincount(_pair_slot(codes[foreign], codes[foreign + 1]), minlength=1 << PAIR_BITS)
    both = np.concatenate([kinds, pairs])
    at = np.flatnonzero(both)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(both[at], pa.int64())], names=["slot", "n"])


class Model:
    """Mutual information of character kinds, and log-probability of character pairs."""

    def __init__(self, slots: np.ndarray, counts: np.ndarray):
        both = np.zeros(_N * _N + (1 << PAIR_BITS), np.int64)
        both[slots] = counts
        n = both[: _N * _N].reshape(_N, _N).astype(np.float64) + 0.05
        total = n.sum()
        self.information = np.log(n * total / (n.sum(1, keepdims=True) * n.sum(0, keepdims=True)))
        self.weight = np.clip(-self.information, LEAST, 3.0)
        # a corpus that holds much garbled text makes its pairs look familiar: kinds that never meet inside
        # words of any orthography stay improbable
        word = [_K[k] for k in ("lower", "accent_lower", "ext_lower")]
        alien = [_K[k] for k in ("accent_upper", "ext_upper", "latin_symbol", "control", "currency", "box", "math", "cyrillic_rare", "letterlike", "greek", "replacement", "han", "combining")]
        for a in word:
            self.weight[a, alien] = np.maximum(self.weight[a, alien], 0.6)
        for a in alien:
            self.weight[a, word] = np.maximum(self.weight[a, word], 0.6)
            self.weight[a, alien] = np.maximum(self.weight[a, alien], 0.3)
        for k in ("accent_upper", "ext_upper"):
            self.weight[_K[k], _K["accent_upper"]] = min(self.weight[_K[k], _K["accent_upper"]], -0.2)
            self.weight[_K[k], word] = np.minimum(self.weight[_K[k], word], 0.2)
        self.weight[_K["han"], _K["han"]] = -0.5
        self.weight[_K["replacement"], :] = self.weight[:, _K["replacement"]] = 1.0
        self.pairs = np.log(both[_N * _N :] + 0.5)
        self.readings: dict[str, dict[int, tuple[float, int]]] = {}

    def segments(self, text: str, codes: np.ndarray, prior: float = 0.0) -> list[tuple[int, int]]:
        """Maximum-scoring segments of improbable pairs as ranges of characters, extended over runs of foreign
        characters; runs of three Latin letters with marks count as improbable. prior is added to each pair."""
        k = _CLASS[codes]
        foreign = codes > 127
        near = foreign[:-1] | foreign[1:]
        score = np.where(near, self.weight[k[:-1], k[1:]], -0.4)
        mixed = foreign[:-1] & foreign[1:] & (k[:-1] != k[1:]) & (_ALIEN[k[:-1]] | _ALIEN[k[1:]])
        score[mixed] = np.maximum(score[mixed], 0.4)
        marked = (k == _K["accent_lower"]) | (k == _K["accent_upper"]) | (k == _K["ext_lower"]) | (k == _K["latin_symbol"])
        if len(k) > 2:
            triple = marked[:-2] & marked[1:-1] & marked[2:]
            score[:-1][triple] = np.maximum(score[:-1][triple], 0.6)
        score = np.where(near, score + prior, score)
        if not (score >= 0.1).any():
            return []
        out: list[tuple[int, int]] = []
        best = total = 0.0
        start = stop = 0
        for i in np.flatnonzero(near):
            if i > stop + 4 or total <= 0:
                if best >= SEGMENT:
                    out.append((start, stop))
                best = total = 0.0
                start = i
            total += score[i]
            if total > best:
                best, stop = total, i + 2
            elif total <= 0:
                stop = max(stop, i)
        if best >= SEGMENT:
            out.append((start, stop))
        wide = []
        for a, b in out:
            while a > 0 and foreign[a - 1]:
                a -= 1
            while b < len(codes) and foreign[b]:
                b += 1
            if wide and a <= wide[-1][1]:
                wide[-1] = (wide[-1][0], max(b, wide[-1][1]))
            else:
                wide.append((int(a), int(b)))
        return wide

    def pair_score(self, text: str) -> float:
        codes = _codes(text)
        foreign = np.flatnonzero((codes[:-1] > 127) | (codes[1:] > 127))
        return float(self.pairs[_pair_slot(codes[foreign], codes[foreign + 1])].sum())


@lru_cache(maxsize=None)
def _to_bytes(encoding: str) -> dict[int, int]:
    """Characters of a single-byte encoding; its undefined bytes as the control characters of their number."""
    out = {}
    for b in range(256):
        try:
            out[ord(bytes([b]).decode(encoding))] = b
        except UnicodeDecodeError:
            out.setdefault(b, b)
    for b in range(0x80, 0xA0):
        out.setdefault(b, b)
    return out


def _plausible(text: str) -> bool:
    for x in text:
        c = ord(x)
        if c < 0xA0 or c == 0xFFFD or 0xE000 <= c < 0xF900:
            return False
        if unicodedata.category(x) in ("Cn", "Cc", "Co", "Cs"):
            return False
    return True


def _utf8_again(run: str, encoding: str) -> str | None:
    """run as bytes of encoding with its UTF-8 sequences decoded; None if there is none."""
    if encoding in EAST:
        try:
            raw = run.encode(encoding)
        except UnicodeEncodeError:
            return None
    else:
        known = _to_bytes(encoding)
        raw = bytearray()
        for x in run:
            b = known.get(ord(x))
            if b is None:
                return None
            raw.append(b)
        raw = bytes(raw)
    found = list(_UTF8.finditer(raw))
    if not found:
        return None
    foreign = sum(b > 127 for b in raw)
    if sum(m.end() - m.start() for m in found) < (0.6 if encoding not in EAST else 0.66) * foreign:
        return None
    out, at = [], 0
    for m in found:
        piece = m.group().decode("utf-8")
        if not _plausible(piece) and not 0x80 <= ord(piece) < 0xA0:
            return None
        rest = raw[at : m.start()]
        try:
            out.append(rest.decode(encoding if encoding in EAST else "latin_1" if encoding not in ("cp1252",) else "cp1252"))
        except UnicodeDecodeError:
            out.append(rest.decode(encoding, "replace"))
        out.append(piece)
        at = m.end()
    try:
        out.append(raw[at:].decode(encoding))
    except UnicodeDecodeError:
        out.append(raw[at:].decode(encoding, "replace"))
    return "".join(out)


_EAST_RESULT = re.compile(r"^[^\x00-\x7f]*[ -ſ‐-‧€™][ -~]*$|^[぀-ヿ一-鿿！-｠、-〿]+$")


@lru_cache(maxsize=200_000)
def undo_utf8(run: str) -> str | None:
    """The run as it read before, if its bytes in one of READ_AS or EAST are UTF-8 sequences."""
    best = None
    han = any(0x3000 <= ord(x) for x in run)
    for encoding in EAST if han else READ_AS:
        out = _utf8_again(run, encoding)
        if out is None or len(out) >= len(run) + (1 if han else 0):
            continue
        if han and not _EAST_RESULT.match(out):
            continue
        if not han and any(0x3000 <= ord(x) < 0x3040 or ord(x) >= 0xAC00 for x in out) and len(out) < 3 and "（" not in out and "。" not in out and "、" not in out:
            continue
        again = undo_utf8(out) if any(ord(x) > 127 for x in out) else None
        out = again or out
        rank = (sum(0x80 <= ord(x) < 0xA0 or ord(x) == 0xFFFD for x in out), len(out))
        if best is None or rank < best[0]:
            best = (rank, out)
    return best[1] if best else None


def _tables() -> list[tuple[str, str, dict[int, str]]]:
    out = []
    for w in MEANT[:1] + ("latin_1",) + MEANT[1:]:
        for r in MEANT:
            if w == r or r == "mac_roman" and w not in ("cp1252", "latin_1"):
                continue
            m = {}
            for c, b in _to_bytes(w).items():
                if b > 127:
                    try:
                        m[c] = bytes([b]).decode(r)
                    except UnicodeDecodeError:
                        continue
            if any(ord(v) != k for k, v in m.items()):
                out.append((w, r, m))
    return out


_SINGLE = _tables()


def _fits(c: str, new: str) -> bool:
    return c == new or bool(_LETTER[_CLASS[min(ord(new), 65535)]]) or new in "«»“”„’‘–—…€"


@lru_cache(maxsize=100_000)
def _fitting(c: str) -> int:
    """The tables, as bits, under which a foreign character becomes a letter or stays."""
    bits = 0
    for i, (_, _, m) in enumerate(_SINGLE):
        if _fits(c, m.get(ord(c), c if c in "“”„’‘–—…" else "\0")):
            bits |= 1 << i
    return bits


_MIXED = re.compile(r"[A-Za-zÀ-ſ][Ѐ-ӿ]|[Ѐ-ӿ][A-Za-zÀ-ſ]")
_BLANK = " \n\t\r"
_HUMP = re.compile(r"[a-zß-öø-ÿ][A-ZÀ-ÖØ-Þ]")
_CYRILLIC = re.compile(r"[Ѐ-ӿ]{3,}")
_ISOLATED = re.compile(r"(?<![A-Za-zÀ-ɏ])[À-ɏ](?![A-Za-zÀ-ɏ])")


def _reads(old: str, new: str) -> bool:
    """Whether new could be words: whole Cyrillic ones, or Latin ones without capitals inside and without
    letters standing alone where there were signs."""
    if any("Ѐ" <= x <= "ӿ" for x in new):
        return bool(_CYRILLIC.search(new))
    return len(_HUMP.findall(new)) <= len(_HUMP.findall(old)) and len(_ISOLATED.findall(new)) <= len(_ISOLATED.findall(old))


_WORD_OF = re.compile(r"[^ \n\t\r]*[^\x00-\x7f][^ \n\t\r]*")
_EASTERN = re.compile(r"[\u2E80-\u9FFF\uAC00-\uD7FF\uFF00-\uFFEF]")


def _word_readings(word: str, model: Model) -> dict[int, tuple[float, int]]:
    """Tables under which the word reads better: gain in log-probability, and characters changed."""
    known = model.readings.get(word)
    if known is not None:
        return known
    foreign = [x for x in word if ord(x) > 127]
    out: dict[int, tuple[float, int]] = {}
    if not all(_CLASS[min(ord(x), 65535)] in _WEAK for x in foreign):
        bits = -1
        for x in set(foreign):
            bits &= _fitting(x)
        before = model.pair_score(f" {word} ")
        i = 0
        while bits > 0 and bits >> i:
            if bits >> i & 1:
                m = _SINGLE[i][2]
                new = word.translate(m)
                changed = [x for x in foreign if m.get(ord(x), x) != x]
                if any(_CLASS[min(ord(x), 65535)] not in _WEAK for x in changed) and not _MIXED.search(new) and _reads(word, new):
                    gain = model.pair_score(f" {new} ") - before
                    if gain > 0:
                        out[i] = (gain, len(changed))
            i += 1
    if len(model.readings) > 300_000:
        model.readings.clear()
    model.readings[word] = out
    return out


def _other_reading(text: str, whole: str, segments: list[tuple[int, int]], model: Model) -> tuple[str, str, str] | None:
    """(read as, meant, text) of the encodings under which the segments' words read best, if they gain enough.
    whole is the text with what it quotes."""
    total: dict[int, list[float]] = {}
    words: set[str] = set()
    for a, b in segments:
        while a > 0 and text[a - 1] not in _BLANK:
            a -= 1
        while b < len(text) and text[b] not in _BLANK:
            b += 1
        words.update(_WORD_OF.findall(text[a:b]))
    for word in words:
        for i, (gain, changed) in _word_readings(word, model).items():
            t = total.setdefault(i, [0.0, 0])
            t[0] += gain
            t[1] += changed
    if total:
        ranked = sorted(total.items(), key=lambda x: -x[1][0])
        i, (gain, changed) = ranked[0]
        if gain >= GAIN * changed + 0.8:
            w, r, m = _SINGLE[i]
            return w, r, _read_again(text, whole, segments, i, ranked[1:], model)
    return _east_reading(text, whole)


def _read_again(text: str, whole: str, segments: list[tuple[int, int]], i: int, others: list, model: Model) -> str:
    """whole as it reads under table i: all of it, since a field is decoded as one; '' if the table knows not
    every foreign character, or if another table that reads almost as well gives another text."""
    m = _SINGLE[i][2]
    foreign = {x for x in whole if ord(x) > 127}
    if any(ord(x) not in m for x in foreign):
        return ""
    fixed = whole.translate(m)
    best = model.pair_score(fixed)
    for k, _ in others:
        other = _SINGLE[k][2]
        if all(ord(x) in other for x in foreign):
            rival = whole.translate(other)
            differ = sum(a != b for a, b in zip(rival, fixed, strict=True))
            if differ and best - model.pair_score(rival) < CLEAR * differ:
                return ""
    return fixed


def _east_whole(text: str, wrong: str, meant: str) -> str | None:
    """text with all its lines decoded as meant; None if any isn't. What wrong has no byte for was never
    read with it and stays."""
    known = _to_bytes(wrong)
    out = []
    for line in text.split("\n"):
        for own, run in groupby(line, lambda x: ord(x) in known):
            piece = "".join(run)
            if own and not piece.isascii():
                try:
                    piece = bytes(known[ord(x)] for x in piece).decode(meant)
                except UnicodeDecodeError:
                    return None
            out.append(piece)
        out.append("\n")
    return "".join(out[:-1])


def _east_reading(text: str, whole: str) -> tuple[str, str, str] | None:
    """(read as, meant, whole restored or "") of the encodings under which a line of text is Japanese; those
    that decode all of whole come first."""
    found: dict[tuple[str, str], None] = {}
    for line in text.split("\n"):
        foreign = [k for k, x in enumerate(line) if ord(x) > 127 and not _EASTERN.match(x)]
        part = line[foreign[0] : foreign[-1] + 1] if foreign else ""
        if len(foreign) < 8 or len(foreign) < 0.4 * len(part):
            continue
        for w in ("cp1252", "latin_1", "mac_roman", "cp437", "cp850", "cp1251"):
            known = _to_bytes(w)
            if any(ord(x) not in known for x in part):
                continue
            raw = bytes(known[ord(x)] for x in part)
            for r in EAST:
                new = raw.decode(r, "replace")
                wide = sum(ord(x) > 127 for x in new)
                if new.count("�") * 10 <= wide <= len(foreign) * 0.7 and sum(0x3040 <= ord(x) < 0x3100 for x in new) * 4 >= wide:
                    found[w, r] = None
    for w, r in found:
        restored = _east_whole(whole, w, r)
        if restored and "�" not in restored:
            return w, r, restored
    return (*next(iter(found)), "") if found else None


#: Foreign characters with what lies between them, East Asian ones apart from the rest.
_PIECE = re.compile(r"[\u2E80-\u9FFF\uAC00-\uD7FF\uFF00-\uFFEF]+|[^\x00-\x7f\u2E80-\u9FFF\uAC00-\uD7FF\uFF00-\uFFEF](?:[^\u2E80-\u9FFF\uAC00-\uD7FF\uFF00-\uFFEF\n]*[^\x00-\x7f\u2E80-\u9FFF\uAC00-\uD7FF\uFF00-\uFFEF])?")
_RUN = re.compile(r"[^\x00-\x7f]{2,}")


_LEFT = re.compile("[\x80-\x84\x86-\x9f\ufffd]")


def _whole(restored: str, model: Model) -> str | None:
    """The restored text, unless there is none, or it would be found damaged itself."""
    if not restored or _LEFT.search(restored):
        return None
    return None if repair(restored, model, again=True)[0] else restored


class _Shown:
    """A text with its numeric entities decoded (shown), the same with what it quotes or speaks of masked
    (plain, of equal length), and the place in the source at which each of their characters begins."""

    def __init__(self, source: str):
        self.source = source
        hidden = sorted(m.span() for r in (_QUOTED, _MENTIONED) for m in r.finditer(source))
        shown: list[str] = []
        plain: list[str] = []
        starts: list[np.ndarray] = []
        self.masked: list[tuple[int, int]] = []
        size = 0

        def take(a: int, b: int, masked: bool) -> None:
            nonlocal size
            if a < b:
                if masked:
                    self.masked.append((size, size + b - a))
                size += b - a
                shown.append(source[a:b])
                plain.append("x" * (b - a) if masked else source[a:b])
                starts.append(np.arange(a, b))

        at = 0
        for a, b in [*hidden, (len(source), len(source))]:
            for m in _ENTITY.finditer(source, at, max(a, at)):
                take(at, m.start(), False)
                shown.append(chr(int(m.group(1))))
                plain.append(shown[-1])
                starts.append(np.array([m.start()]))
                size += 1
                at = m.end()
            take(at, a, False)
            take(max(a, at), b, True)
            at = max(at, b)
        self.shown, self.plain = "".join(shown), "".join(plain)
        self.start = np.append(np.concatenate(starts) if starts else np.array([], np.int64), len(source))

    def unmasked(self, segments: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
        """The parts of segments that lie in no quotation."""
        for a, b in segments:
            for c, d in self.masked:
                if c < b and d > a:
                    if a < c:
                        yield a, c
                    a = d
            if a < b:
                yield a, b

    def spelled(self, a: int, b: int) -> str:
        """The characters a to b as the source has them."""
        return self.source[self.start[a] : self.start[b]]


def _by_runs(it: _Shown, first: int, last: int, fixed: str) -> list[tuple[int, int, str]]:
    """The piece's reading run by run where that makes the same, so that an entity between its runs stays one."""
    if it.start[last] - it.start[first] == last - first:
        return [(first, last, fixed)]
    runs = [(*m.span(), undo_utf8(m.group())) for m in _RUN.finditer(it.plain, first, last)]
    runs = [r for r in runs if r[2]]
    at, made = first, ""
    for a, b, new in runs:
        made += it.plain[at:a] + new
        at = b
    return runs if made + it.plain[at:last] == fixed else [(first, last, fixed)]


def _undone(it: _Shown, segments: list[tuple[int, int]]) -> tuple[list[tuple[int, int, str]], bool]:
    """(places and readings of the pieces of segments that are UTF-8, whether another piece is lost)."""
    out, lost = [], False
    for a, b in it.unmasked(segments):
        for m in _PIECE.finditer(it.plain, a, b):
            first, last = m.span()
            fixed = undo_utf8(m.group())
            if fixed is None and _EASTERN.match(m.group()):
                follow = it.plain[last : last + 1]
                fixed = undo_utf8(m.group() + follow) if follow and ord(follow) < 128 else None
                last += fixed is not None
            if fixed is None:
                lost |= bool(re.match(r"â€|â\x80", m.group()))
            elif not out or first >= out[-1][1]:
                out += _by_runs(it, first, last, fixed)
    return out, lost


def repair(text: str, model: Model, again: bool = False) -> tuple[bool, str | None, str | None]:
    """(damaged, restored text where all damage could be undone, how). What isn't damaged, quotations and
    entities too, stands in the restored text as it was. A restored text is looked at again: with again, only
    whether it's damaged is told."""
    if not text or text.isascii() and not _ENTITY.search(text):
        return False, text, None
    it = _Shown(text)
    if it.plain.isascii():
        return False, text, None
    codes = _codes(it.plain)
    segments = model.segments(it.plain, codes)
    if not segments:
        return False, text, None
    lost = "�" in it.plain
    found, broken = _undone(it, segments)
    if found:
        # the field is known to be damaged: less improbable segments are tested too, run by run
        taken = np.zeros(len(it.plain) + 1, bool)
        for first, last, _ in found:
            taken[first:last] = True
        for a, b in it.unmasked(model.segments(it.plain, codes, DAMAGED)):
            for m in _RUN.finditer(it.plain, a, b):
                fixed = None if taken[m.start() : m.end()].any() else undo_utf8(m.group())
                if fixed:
                    found.append((*m.span(), fixed))
        out, at = [], 0
        for first, last, fixed in sorted(found):
            out += [it.spelled(at, first), fixed]
            at = last
        if lost or broken or again:
            return True, None, "utf-8"
        restored = _whole("".join(out) + it.spelled(at, len(it.plain)), model)
        if restored is None:
            # bytes of another encoding can look like UTF-8 here and there
            other = _other_reading(it.plain, it.shown, segments, model)
            again = _whole(other[2], model) if other else None
            if again:
                return True, again, f"{other[1]} as {other[0]}"
        return True, restored, "utf-8"
    if lost or broken:
        return True, None, None
    # a run that isn't UTF-8 is damage only if another encoding reads far better
    other = _other_reading(it.plain, it.shown, segments, model)
    if other and again:
        return True, None, None
    if other:
        return True, _whole(other[2], model), f"{other[1]} as {other[0]}"
    return False, text, None


_OUT = "scrape_id bigint, field string, damaged boolean, restored string, how string"


def _repair_batches(sent):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model: Model = sent.value
        for pdf in batches:
            rows = []
            for field in ("text", "raw_text"):
                for i, t in zip(pdf["scrape_id"], pdf[field], strict=True):
                    if t:
                        damaged, restored, how = repair(t, model)
                        if damaged:
                            rows.append((i, field, damaged, restored, how))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _OUT.split(", ")])

    return run


def garbled_fields(scrapes: DataFrame) -> DataFrame:
    """(scrape_id, field, damaged, restored, how) of every text and raw_text that wrong decoding damaged.

    restored is NULL where damage can't be undone. NULL, empty and ASCII fields
    without numeric entities are never damaged. The
    declared charset isn't used: it is wrong as often as it is right where text is garbled.
    """
    counts = scrapes.select("text", "raw_text").mapInArrow(_count_pairs, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    model = Model(counts.column("slot").to_numpy(), counts.column("n").to_numpy())
    sent = scrapes.sparkSession.sparkContext.broadcast(model)
    return scrapes.select("scrape_id", "text", "raw_text").mapInPandas(_repair_batches(sent), _OUT)


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    return garbled_fields(table(spark, base, "scrapes")).select("scrape_id", "field")


def p1_restored(spark: SparkSession, base: str) -> DataFrame:
    """The damaged fields whose text could be had again."""
    return garbled_fields(table(spark, base, "scrapes")).where("restored IS NOT NULL").select("scrape_id", "field", "restored", "how")


QUERIES = {"p1_found": p1_found, "p1_restored": p1_restored}
ORACLES: dict[str, str] = {}
