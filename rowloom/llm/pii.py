r"""Personal data: fixed patterns plus a character BiLSTM with CRF transitions.

The patterns give the base spans (email, ip, card, phone); the tagger adds spans of the same kinds that the patterns
miss, such as phone numbers without an international prefix, and secrets (keys and access tokens), which no pattern
covers. It is trained in numpy on the driver from labelled spans that ``labelled_windows`` writes (a fixed number of
windows, a fixed seed: the weights never depend on the input).

Texts are tagged in overlapping windows. Every window with a digit or ``@`` is tagged; spans without either are not
well-formed for any kind, so the other windows have nothing to give. Where windows overlap their scores are averaged,
each weighted towards its middle, and one Viterbi pass over each stretch of touching windows decides all of its
characters together, so that spans that cross window borders come out whole. An added span must be likely (``LOG_ODDS``
against no span there), well-formed for its kind and clear of base spans, which always stay.

Defined results: null and empty texts have no spans; repeated rows are tagged each; an empty table gives no rows;
texts are read whole. Scores are averaged as they come, ``TOGETHER`` windows at a time, so memory is 44 bytes for each
character of the stretches at hand. Only doc_id and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tagger
from .common import spread, text_slices
from .tagger import KINDS, STRIDE, WINDOW

BASE_KINDS = KINDS[:4]
N_TRAINING, EPOCHS, SEED, LOG_ODDS = 8192, 5, 11, 3.0
#: Windows that are tagged at once.
TOGETHER = 2048
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin at the first digit of a run, so later starts in it are not tried.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT, _TRIGGER = re.compile("[0-9]"), re.compile("[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind as in KINDS."""
    out, last = [], 0
    if "@" in text:
        for m in _AT.finditer(text):
            start = m.start()
            while start > last and _LOCAL.match(text[start - 1]):
                start -= 1
            if start < m.start():
                out.append(("email", start, m.end()))
                last = m.end()
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m[0].split("."))]
        out += [("card", *m.span()) for m in _CARD.finditer(text) if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _well_formed(kind: str, text: str) -> bool:
    digits = _digits(text)
    if kind == "email":
        return re.fullmatch(r"[^\s@]+\s?@\s?[^\s@]+\.[^\s@]*[^\W\d_]", text) is not None
    if kind == "ip":
        return re.fullmatch(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", text) is not None and all(int(p) < 256 for p in text.split("."))
    if kind == "secret":
        return len(text) >= 16 and re.fullmatch(r"[A-Za-z0-9_+/=.-]+", text) is not None and re.search("[0-9]", text) is not None and re.search("[A-Za-z]", text) is not None
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits) and re.fullmatch(r"[0-9 .-]+", text) is not None
    return 9 <= len(digits) <= 15 and re.fullmatch(r"[+(]?[0-9][0-9 ().-]*[0-9]", text) is not None and len(re.findall(r"[ ().-]+", text)) >= 2 and text.count("(") == text.count(")")


def labelled_windows(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of character classes and tags, written from rules: prose with spans of each kind, and look-alikes."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[rng.integers(len(xs))]
    number = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    syllables = "an ch de en er ge in lo ma ment na or que re ta ti tion un vi é ü ñ ó".split()
    word = lambda: "".join(pick(syllables) for _ in range(rng.integers(1, 5)))

    def card() -> str:
        d = pick(["4", "51", "37"]) + number(rng.integers(11, 14))
        check = next(c for c in "0123456789" if luhn(d + c))
        d += check
        sep = pick(["", " ", "-"])
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4)) if sep else d

    def phone() -> str:
        a, b, c = number(3), number(3), number(4)
        return pick([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{pick(['1', '44', '49', '33'])} ({a}) {b}-{c}", f"+{number(2)} {a} {b} {c}", f"0{number(2)} {b} {c}{number(1)}", f"1-{a}-{b}-{c}"])

    def email() -> str:
        asc = lambda: re.sub("[^a-z]", "a", word())
        return f"{asc()}{pick(['', '.', '_', '-'])}{pick(['', asc(), number(2)])}{'x' * 0}@{asc()}{pick(['', '-' + asc()])}.{pick(['com', 'org', 'net', 'de', 'co.uk', 'example.com'])}"

    mixed = lambda alphabet, k: "".join(pick(alphabet) for _ in range(k))
    hexa, capitals = "abcdef0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    every = capitals + capitals.lower()[:26]

    def secret() -> str:
        kind = rng.integers(6)
        return [lambda: mixed(hexa, pick([32, 40, 40, 40, 64])), lambda: "sk_" + pick(["", "live_", "test_"]) + mixed(every, pick([24, 32])), lambda: "AKIA" + mixed(capitals, 16), lambda: "ghp_" + mixed(every, 36), lambda: mixed(every, pick([24, 32, 40, 48])), lambda: f"{mixed(every, 20)}.{mixed(every, 24)}"][kind]()

    makers = {"email": email, "ip": lambda: ".".join(str(x) for x in rng.integers(0, 256, 4)), "card": card, "phone": phone, "secret": secret}
    named = lambda: f"{pick(['token', 'key', 'api_key', 'password', 'secret', 'TOKEN', 'bearer'])}{pick([' = ', '=', ': ', ' '])}"
    look_alikes = [
        lambda: number(rng.integers(1, 5)), lambda: f"{rng.integers(1900, 2100)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}", lambda: f"{number(2)}.{number(2)}.{number(4)}", lambda: f"{number(1)}.{number(1)}.{number(2)}", lambda: f"${number(3)}.{number(2)}",
        lambda: f"#{number(6)}", lambda: f"{number(2)}:{number(2)}", lambda: f"@{word()}", lambda: f"{word()}_{number(4)}", lambda: f"{number(3)},{number(3)},{number(3)}", lambda: number(rng.integers(8, 20)),
        lambda: f"{number(2)}%", lambda: f"{word()}{number(2)}", lambda: f"{number(4)}-{number(2)}", lambda: f"{word().upper()}-{number(3)}", lambda: named() + word(), lambda: "".join(word() for _ in range(6)),
    ]
    chars, tags = np.zeros((n, WINDOW), np.int8), np.zeros((n, WINDOW), np.int8)
    for row in range(n):
        text, marks = "", []
        while len(text) < 2 * WINDOW:
            what = rng.random()
            if what < 0.22:
                kind = pick(KINDS)
                piece = makers[kind]()
                before, quote = (named() if rng.random() < 0.6 else "", pick(["", '"', '"', "'"])) if kind == "secret" else ("", "")
                at = len(text) + len(before) + len(quote)
                marks.append((KINDS.index(kind), at, at + len(piece)))
                piece = before + quote + piece + quote
            elif what < 0.4:
                piece = pick(look_alikes)()
            else:
                piece = " ".join(word() for _ in range(rng.integers(1, 6)))
            text += piece + pick([" ", " ", " ", "\n", ". ", ", ", "; "])
        at = rng.integers(0, len(text) - WINDOW)
        tag = np.zeros(len(text), np.int8)
        for k, s, e in marks:
            tag[s:e], tag[s] = 2 * k + 2, 2 * k + 1
        chars[row], tags[row] = tagger.character_classes(text)[at : at + WINDOW], tag[at : at + WINDOW]
    return chars, tags


@lru_cache(maxsize=1)
def trained(n: int = N_TRAINING, epochs: int = EPOCHS, seed: int = SEED) -> dict:
    """Weights from the labelled windows: about 5,000 numbers."""
    return tagger.train(*labelled_windows(n, seed), epochs, seed)


def _stretches(text: str) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Starts of the windows with a trigger, and runs of touching ones as index ranges."""
    at = np.fromiter((m.start() for m in _TRIGGER.finditer(text)), np.int64)
    tile = at // STRIDE
    # A character lies in the window that starts at its tile and in the one that starts a tile earlier.
    starts = np.unique(np.concatenate([tile, np.maximum(tile - 1, 0)])) * STRIDE
    cuts = np.flatnonzero(np.diff(starts) > STRIDE) + 1
    return starts, list(zip(np.r_[0, cuts], np.r_[cuts, len(starts)]))


_WEIGHT = (1 + np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1])).astype(np.float32)


def _log_odds(p: dict, scores: np.ndarray, tags: np.ndarray, s: int, e: int) -> float:
    """How much the decoded path gains over the same path with characters s to e - 1 outside of any span."""
    path, outside = tags[s:e], np.zeros(e - s, np.int8)
    if s == 0:
        odds = p["S"][path[0]] - p["S"][0]
    else:
        odds = p["A"][tags[s - 1], path[0]] - p["A"][tags[s - 1], 0]
    if e < len(tags):
        odds += p["A"][path[-1], tags[e]] - p["A"][0, tags[e]]
    at = np.arange(s, e)
    odds += (scores[at, path] - scores[at, outside]).sum() + (p["A"][path[:-1], path[1:]] - p["A"][0, 0]).sum()
    return float(odds)


def _decoded(p: dict, begin: int, scores: np.ndarray) -> list[tuple[str, int, int]]:
    """Spans of a stretch that starts at ``begin``, decoded as a whole from its averaged scores."""
    found, tags = [], tagger.best_tags(p, scores)
    for s in np.flatnonzero(tags % 2 == 1):
        e = s + 1
        while e < len(tags) and tags[e] == tags[s] + 1:
            e += 1
        if _log_odds(p, scores, tags, s, e) >= LOG_ODDS:
            found.append((KINDS[tags[s] // 2], int(begin + s), int(begin + e)))
    return found


def tagged_spans(p: dict, texts: list[str], every: bool = False) -> list[list[tuple[str, int, int]]]:
    """Confident spans of each text. ``TOGETHER`` windows of some stretches, or of a part of a long one, are scored at
    once. ``every`` tags all windows, those without a digit or ``@`` too."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    waiting: list[tuple] = []  # windows, where to add their scores, and the sums
    open_: list[tuple] = []  # stretches whose windows are all scored or waiting

    def score() -> None:
        if waiting:
            scores = tagger.emissions(p, np.stack([w for w, *_ in waiting]))
            for one, (_, at, total, weight) in zip(scores, waiting):
                size = min(WINDOW, len(total) - at)
                total[at : at + size] += one[:size] * _WEIGHT[:size, None]
                weight[at : at + size] += _WEIGHT[:size]
            waiting.clear()
        for i, begin, total, weight in open_:
            out[i] += _decoded(p, begin, total / weight[:, None])
        open_.clear()

    for i, text in enumerate(texts):
        if not text or not every and not _TRIGGER.search(text):
            continue
        if every:
            starts = np.arange(0, max(1, len(text) - STRIDE), STRIDE)
            runs = [(0, len(starts))]
        else:
            starts, runs = _stretches(text)
        classes = np.concatenate([tagger.character_classes(text), np.zeros(WINDOW, np.int8)])
        for a, b in runs:
            begin, end = starts[a], min(starts[b - 1] + WINDOW, len(text))
            total, weight = np.zeros((end - begin, tagger.N_TAGS), np.float32), np.zeros(end - begin, np.float32)
            for start in starts[a:b]:
                waiting.append((classes[start : start + WINDOW], start - begin, total, weight))
                if len(waiting) >= TOGETHER:
                    score()
            open_.append((i, begin, total, weight))
    score()
    return out


def spans(p: dict, texts: list[str | None]) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """(base spans, all spans) of each text."""
    texts = [t or "" for t in texts]
    out = []
    for text, tagged in zip(texts, tagged_spans(p, texts)):
        base = base_spans(text)
        clear = lambda s, e: all(e <= a or b <= s for _, a, b in base)  # noqa: B023, E731
        edge = lambda i: not (0 <= i < len(text)) or not (text[i].isalnum() or text[i] in "@_")  # noqa: B023, E731
        added = [x for x in tagged if clear(x[1], x[2]) and edge(x[1] - 1) and edge(x[2]) and _well_formed(x[0], text[x[1] : x[2]])]
        out.append((base, sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0]), s[2])) if added else base))
    return out


SPAN = "array<struct<kind:string,start:int,end:int>>"


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, base, found: arrays of (kind, start, end) in code points; ``found`` holds the base spans too."""
    p = docs.sparkSession.sparkContext.broadcast(trained())
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    listed = lambda rows: pa.array([[dict(zip(("kind", "start", "end"), s)) for s in x] for x in rows], pa.list_(span))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            both = spans(p.value, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), listed(b for b, _ in both), listed(a for _, a in both)], ["doc_id", "base", "found"])

    rows = spread(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")))
    return rows.mapInArrow(emit, f"doc_id long, base {SPAN}, found {SPAN}")


def masked(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets."""
    p = docs.sparkSession.sparkContext.broadcast(trained())

    def hide(text: str | None, found: list) -> str | None:
        if not text:
            return text
        out, at = [], 0
        for kind, s, e in found:
            if s >= at:
                out += [text[at:s], f"[{kind}]"]
            at = max(at, e)
        return "".join([*out, text[at:]])

    names = keep or docs.columns

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            texts = batch.column("text").to_pylist()
            hidden = [hide(t, found) for t, (_, found) in zip(texts, spans(p.value, texts))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(hidden, pa.string())], ["row", "text"])

    rows = spread(docs.select(F.struct(*[docs[c] for c in names if c != "text"]).alias("row"), docs["text"].alias("text")))
    out = rows.mapInArrow(emit, rows.schema)
    return out.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in names])
