"""Personal data: exact rules, and a semi-Markov conditional random field for what they miss.

The rules find e-mail addresses, IP addresses, card numbers and phone numbers, leftmost
and non-overlapping by kind, in time linear in the text. People also write them in
other ways ("name (at) host dot org", "00 1 803 555-5351", "10[.]0[.]0[.]1"). Around
anything that could be such a thing, a window of tokens is cut; the field scores whole
spans of it (shape, digits, checksum, octets, separators, both neighbours), and a
dynamic program over spans of at most ``LONGEST`` tokens chooses boundaries and types
together. A span is added if it meets no span of the rules and its marginal probability
is at least ``SURE``; the rules' spans always stay.

The field is trained here, on at most ``TRAIN_WINDOWS`` different windows of the
corpus, the least by a hash of the window: the rules' spans are its labels, the rest of
the windows its counterexamples. Each found span is also learned in rewritten forms
(the rules of rewriting are below), and some look-alikes are learned as none (dates,
versions, cards with a wrong digit). Scoring is a scan without a shuffle.

Defined cases: null texts count as empty, and both give no spans; positions are code
points, ends exclusive; spans of different kinds may overlap where the rules say so;
null ids and repeated rows are rows like others; without any window to learn from
nothing is added; empty tables give empty results; ``find_spans`` passes other columns
through and replaces one named ``spans``.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import staged, table
from .semi_crf import LONGEST, SEGMENT_FEATURES, TOKEN_FEATURES, Lattice, SemiCrf, hashed

KINDS = ("email", "ip", "card", "phone")
#: Bound of the windows that the field is fitted on.
TRAIN_WINDOWS = 1500
#: Marginal probability from which a span is added.
SURE = 0.8
#: Tokens kept around what makes a window, and windows decoded at a time.
AROUND, AT_ONCE = 4, 64

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def octet(digits: str) -> bool:
    return len(digits.lstrip("0")) <= 3 and int(digits.lstrip("0") or "0") <= 255


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            yield start, done
        at = text.find("@", m.end() if m else at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by the rules, by kind as in KINDS, then by start."""
    out = [("email", s, e) for s, e in emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(octet, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(digits := only_digits(m[0])) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(only_digits(m[0])) <= 15]
    return out


# What makes a window: seven digits or more with separators, a dotted quad written otherwise, or an at sign and a dot, however written.
_HOST, _DOT = r"\s?[A-Za-z0-9-]+", r"\s?[(\[{]\s?dot\s?[)\]}]\s?|\sdot\s"
_DIGITS = re.compile(r"(?<![0-9])[0-9](?:[\x20()./_-]{0,3}[0-9]){6,}|(?<![0-9])[0-9]{1,3}(?:\s?[\[(]\s?(?:\.|dot)\s?[\])]\s?[0-9]{1,3}){3}")
_SIGNED = re.compile(rf"@{_HOST}(?:\.|\s\.\s|{_DOT})[A-Za-z0-9-]+", re.I)
_BRACED = re.compile(rf"[(\[{{]\s?at\s?[)\]}}]{_HOST}(?:\.|\s\.\s|{_DOT})[A-Za-z0-9-]+", re.I)
_SPOKEN = re.compile(rf"\sat\s{_HOST}(?:{_DOT})[A-Za-z0-9-]+", re.I)
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\S")
#: Letters before a trigger that its window takes in at most (an address may have a long name), and the same after it.
_REACH = 80


def triggers(text: str, low: int = 0, high: int | None = None) -> list[tuple[int, int]]:
    """Where a window must be, in order; each pattern runs only on texts that hold what it needs."""
    end = len(text) if high is None else high
    found = [m.span() for m in _DIGITS.finditer(text, low, end)]
    if text.find("@", low, end) >= 0:
        found += [m.span() for m in _SIGNED.finditer(text, low, end)]
    said = text[low:end].lower() if high is not None else text.lower()
    if "at)" in said or "at]" in said or "at}" in said or "at )" in said or "at ]" in said:
        found += [m.span() for m in _BRACED.finditer(text, low, end)]
    if "dot" in said:
        found += [m.span() for m in _SPOKEN.finditer(text, low, end)]
    return sorted(found)


def windows(text: str) -> Iterator[tuple[int, int]]:
    """Stretches around triggers, joined where they meet."""
    low = high = None
    for start, end in triggers(text):
        a, b = max(0, start - _REACH), min(len(text), end + _REACH)
        if high is not None and a <= high:
            high = max(high, b)
            continue
        if high is not None:
            yield low, high
        low, high = a, b
    if high is not None:
        yield low, high


def _sign(token: str) -> str:
    if token.isascii() and token.isdigit():
        return "9" * min(len(token), 5)
    low = token.lower()
    return {"at": "@", "dot": "."}.get(low, "a") if low.isalpha() else token


def _class(c: str) -> str:
    return "" if not c else "9" if c.isdigit() else "a" if c.isalpha() else "_" if c.isspace() else c


def _bucket(n: int) -> str:
    return next(name for name, top in (("0", 0), ("few", 6), ("short", 8), ("phone", 12), ("long", 15), ("16", 16), ("card", 19), ("many", 1 << 60)) if n <= top)


_COARSE = re.compile(r"[a9]+(?:[._+%-]?[a9]+)*")


class Window:
    """A stretch of a text as tokens, with its candidate segments and their features."""

    def __init__(self, text: str, low: int, high: int, taken: list[tuple[str, int, int]] = ()) -> None:
        """``taken``: spans of the rules that no candidate may meet."""
        self.spans = [m.span() for m in _TOKEN.finditer(text, low, high)]
        near = self.near(text, low, high)
        if near:
            self.spans = self.spans[near[0] : near[1]]
        self.text = text
        words = [text[a:b] for a, b in self.spans]
        self.signs = [_sign(w) for w in words]
        n = len(words)
        gap = ["_" if i and self.spans[i - 1][1] < self.spans[i][0] else "" for i in range(n)]
        inside = lambda at: 0 < at < len(text) and text[at - 1].isalnum() and text[at].isalnum()
        blocked = [any(a < e and s < b for _, s, e in taken) for a, b in self.spans]
        digits = [len(w) if s[0] == "9" else 0 for w, s in zip(words, self.signs)]
        self.starts, self.lengths, self.features = [], [], []
        for i in range(n):
            if inside(self.spans[i][0]) or blocked[i] or not (words[i][0].isalnum() or words[i][0] in "+("):
                continue
            count, at_sign, dots, shape = 0, 0, 0, ""
            for j in range(i, min(n, i + LONGEST)):
                if blocked[j]:
                    break
                sign = self.signs[j]
                shape += (gap[j] if j > i else "") + sign
                count += digits[j]
                at_sign += sign == "@"
                dots += sign == "." and at_sign > 0
                tail = words[j]
                if inside(self.spans[j][1]) or not (tail[-1].isalnum() or tail[-1] == ")") or not (count >= 4 or (at_sign and dots and tail.isalpha())):
                    continue
                self.starts.append(i)
                self.lengths.append(j - i + 1)
                self.features.append(self.segment(i, j, shape, count, at_sign, dots, words, digits))
        self.tokens = [(hashed(f"o{s}"), hashed("o" + s[0] + (self.signs[k + 1][0] if k + 1 < n else "")), hashed("o")) for k, s in enumerate(self.signs)]

    def near(self, text: str, low: int, high: int) -> tuple[int, int] | None:
        """The tokens that meet a trigger, with AROUND tokens on either side; all in between where there are several triggers."""
        hit = triggers(text, low, high)
        at = [k for k, (a, b) in enumerate(self.spans) if any(a < e and s < b for s, e in hit[:1] + hit[-1:])]
        return (max(0, at[0] - 2 * AROUND), at[-1] + 1 + AROUND) if at else None

    def segment(self, i: int, j: int, shape: str, count: int, at_sign: int, dots: int, words: list[str], digits: list[int]) -> list[int]:
        a, b = self.spans[i][0], self.spans[j][1]
        left, right = _class(self.text[a - 1 : a]), _class(self.text[b : b + 1])
        numbers = [w for w, d in zip(words[i : j + 1], digits[i : j + 1]) if d]
        checked = 13 <= count <= 19 and luhn("".join(numbers))
        quad = len(numbers) == 4 and all(map(octet, numbers)) and not set(shape) - set("9._[]()")
        marks = "".join(sorted(set(shape) - set("9a")))
        coarse = _COARSE.sub("x", shape)
        known = ("b", f"s{shape}", f"c{coarse}", f"n{_bucket(count)}", f"l{left}", f"r{right}", f"k{checked}{count == 16}{marks}", f"q{quad}", f"m{marks}{'a' in shape}")
        ends = (f"e{self.signs[i][0]}{self.signs[j][0]}", f"a{min(at_sign, 2)}{min(dots, 3)}{len(words[j]) if 1 < len(words[j]) < 7 and dots else ''}")
        return [hashed(f) for f in (*known, *ends)]

    def lattice(self, gold: list[tuple[str, int, int]] = ()) -> Lattice:
        first, last = {a: k for k, (a, _) in enumerate(self.spans)}, {b: k for k, (_, b) in enumerate(self.spans)}
        known, done = [], -1
        candidates = set(zip(self.starts, self.lengths))
        for kind, s, e in sorted(gold, key=lambda g: (g[1], -g[2])):
            if s in first and e in last and first[s] > done and (first[s], last[e] - first[s] + 1) in candidates:
                known.append((first[s], last[e] - first[s] + 1, KINDS.index(kind) + 1))
                done = last[e]
        whole = lambda x, width: np.array(x, np.int64).reshape(-1, width)
        return Lattice(whole(self.tokens, TOKEN_FEATURES), np.array(self.starts, np.int64), np.array(self.lengths, np.int64), whole(self.features, SEGMENT_FEATURES), known)


def rewritten(kind: str, span: str, rng: random.Random) -> str:
    """Another way in which people write what the rules found."""
    if kind == "email":
        name, _, host = span.partition("@")
        if rng.random() < 0.7:
            name = rng.choice((re.sub("[^A-Za-z]", "", name), re.sub("[0-9]+", "x", name), "j." + name, name + "_b")) or name
            labels = host.split(".")
            host = rng.choice((".".join(labels[-2:]), re.sub("[0-9]", "", host), f"{labels[0]}.{rng.choice(('org', 'net', 'de', 'io', 'co'))}"))
        at, dot = rng.choice((("(at)", "."), ("[at]", "[dot]"), (" at ", " dot "), (" (at) ", " (dot) "), (" @ ", "."), ("[at]", ".")))
        return name + at + host.replace(".", dot)
    if kind == "ip":
        return span.replace(".", rng.choice(("[.]", "(.)", "[dot]")))
    digits = only_digits(span)
    if kind == "card":
        groups = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        return rng.choice((".", "/", "_", "  ", " - ")).join(groups)
    area, middle, end = digits[-10:-7], digits[-7:-4], digits[-4:]
    return rng.choice((f"({area}) {middle}-{end}", f"00 {digits[:-10]} {area} {middle}-{end}", f"{area}-{middle}-{end}", f"{area}.{middle}.{end}", f"{area} / {middle} {end}")).replace("  ", " ")


def lookalike(kind: str, span: str, rng: random.Random) -> str:
    """Something that only looks like what the rules found."""
    n = lambda low, high: str(rng.randint(low, high))
    plain = "".join(n(0, 9) for _ in range(rng.randint(7, 20)))
    when = f"{n(1990, 2039)}-{n(10, 12)}-{n(10, 28)}"
    secret = "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice((16, 32, 36, 40, 64))))
    choices = [plain, secret, secret[:8] + "-" + secret[8:12] + "-" + secret[12:], when + f" {n(10, 23)}:{n(10, 59)}:{n(10, 59)}", f"{n(10, 28)}.{n(10, 12)}.{n(1990, 2039)}", f"{n(1990, 2039)}-{n(1990, 2039)}", f"{n(300, 999)}.{n(300, 999)}.{n(100, 999)},{n(10, 99)}", " ".join(n(100, 99999) for _ in range(4)), " ".join(n(0, 99) for _ in range(rng.randint(5, 12))), f"{n(1, 9)}.{n(10, 99)}.{n(1000, 9999)}.{n(10, 99)}", f"v{n(1, 9)}.{n(0, 9)}.{n(1000, 9999)}-{n(10, 99)}", f"{n(100, 999)}-{n(1, 9)}-{n(10, 99)}-{n(100000, 999999)}-{n(1, 9)}"]
    if kind == "card":
        k = rng.randrange(len(span))
        while not "0" <= span[k] <= "9":
            k = rng.randrange(len(span))
        wrong = span[:k] + str((int(span[k]) + rng.randint(1, 9)) % 10) + span[k + 1 :]
        choices = [*choices[:2], wrong, rewritten("card", wrong, rng), rewritten("card", plain, rng)]
    if kind == "email":
        choices = ["met at noon dot", "look at this. Then", f"seen at {when}", "@ 5.30", f"@name {plain}"]
    return rng.choice(choices)


def lessons(text: str) -> list[Lattice]:
    """What a window teaches: itself, and, for each span, a rewritten one and a look-alike in its place."""
    out = []

    def learn(changed: str, gold: list[tuple[str, int, int]]) -> None:
        for low, high in windows(changed):
            made = Window(changed, low, high)
            if made.starts:
                out.append(made.lattice(gold))

    found = base_spans(text)
    learn(text, found)
    rng = random.Random(zlib.crc32(text.encode("utf-8", "surrogatepass")))
    for kind, s, e in found:
        others = [g for g in found if g[1] >= e or g[2] <= s]
        for new, positive in ((rewritten(kind, text[s:e], rng), True), (rewritten(kind, text[s:e], rng), True), (lookalike(kind, text[s:e], rng), False)):
            changed, shift = text[:s] + new + text[e:], len(new) - (e - s)
            moved = [(k, a + shift * (a >= e), b + shift * (a >= e)) for k, a, b in others]
            rules = [g for g in base_spans(changed) if g[1] < s + len(new) and s < g[2]]
            own = [(kind, s, s + len(new))] if positive and not rules else rules
            learn(changed, moved + own)
    return out


def train(texts: list[str]) -> SemiCrf | None:
    """The field of the windows' lessons; None where there is none to learn from."""
    lattices = [x for text in sorted(texts) for x in lessons(text)]
    if not any(x.gold for x in lattices):
        return None
    model = SemiCrf(len(KINDS))
    model.train(lattices)
    return model


def training_windows(df: DataFrame, text_col: str, most: int = TRAIN_WINDOWS) -> DataFrame:
    """(at, window): at most ``most`` different windows of the whole column, the least by a hash of the window.

    Every task hands on no more than ``most`` of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, str] = {}
        heap: list[int] = []
        for batch in batches:
            for value in batch.column(0):
                text = value.as_py() or ""
                for low, high in windows(text):
                    # a window of many triggers is learned by its first ones only; all are scored
                    part = text[low : min(high, low + 8 * _REACH)]
                    at = int.from_bytes(hashlib.blake2b(part.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)
                    if at in kept or len(heap) >= most and at >= -heap[0]:
                        continue
                    kept[at] = part
                    heapq.heappush(heap, -at)
                    if len(heap) > most:
                        del kept[-heapq.heappop(heap)]
        yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.int64()), pa.array(list(kept.values()), pa.string())], names=["at", "window"])

    found = df.select(F.col(text_col).cast("string").alias("t")).mapInArrow(run, "at long, window string")
    return found.dropDuplicates(["at"]).orderBy("at").limit(most)


def fit(df: DataFrame, text_col: str = "text", most: int = TRAIN_WINDOWS) -> SemiCrf | None:
    """The field, trained in one task on the bounded sample of windows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts = [w for frame in frames for w in frame.window]
        yield pd.DataFrame({"model": [zlib.compress(pickle.dumps(train(texts)), 1)]})

    sample = staged(training_windows(df, text_col, most), "pii-windows")
    made = sample.repartition(1).mapInPandas(run, "model binary").collect()
    return pickle.loads(zlib.decompress(made[0].model)) if made else None


def added_spans(texts: list[str], base: list[list[tuple[str, int, int]]], model: SemiCrf | None, sure: float = SURE) -> list[list[tuple[str, int, int]]]:
    """Per text the spans that the field adds to those of the rules."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    if model is None:
        return out
    waiting: list[tuple[int, Window]] = []

    def decode() -> None:
        waiting.sort(key=lambda x: len(x[1].spans))
        for k in range(0, len(waiting), AT_ONCE):
            part = waiting[k : k + AT_ONCE]
            for (row, window), found in zip(part, model.decode([w.lattice() for _, w in part])):
                for i, n, kind, p in found:
                    start, end = window.spans[i][0], window.spans[i + n - 1][1]
                    if p >= sure and plausible(KINDS[kind - 1], window.text[start:end]):
                        out[row].append((KINDS[kind - 1], start, end))
        waiting.clear()

    for row, (text, taken) in enumerate(zip(texts, base)):
        for low, high in windows(text):
            made = Window(text, low, high, [t for t in taken if t[1] < high and low < t[2]])
            if made.starts:
                waiting.append((row, made))
        if len(waiting) >= 16 * AT_ONCE:
            decode()
    decode()
    return out


def plausible(kind: str, span: str) -> bool:
    """What the rules ask of a kind's content holds for added spans too."""
    numbers = re.findall("[0-9]+", span)
    digits = "".join(numbers)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "ip":
        return len(numbers) == 4 and all(map(octet, numbers))
    return kind == "email" or 9 <= len(digits) <= 15


SPANS = "array<struct<kind:string,start:int,end:int,text:string,rule:boolean>>"


def find_spans(df: DataFrame, model: SemiCrf | None, text_col: str = "text", sure: float = SURE, keep_text: bool = True) -> DataFrame:
    """``df`` with ``spans``: kind, start, end and text of all personal data, by kind, then start; ``rule`` is false for what the field added."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    others = [F.col(c) for c in df.columns if c != "spans" and (keep_text or c != text_col)]
    packed = df.select(F.struct(*others).alias("all"), F.col(text_col).cast("string").alias("t"))
    schema = T.StructType([packed.schema["all"], T.StructField("spans", T._parse_datatype_string(SPANS))])
    kind_of_spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()), ("rule", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = sent.value
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            base = [base_spans(t) for t in texts]
            rows = []
            for text, ruled, more in zip(texts, base, added_spans(texts, base, field, sure)):
                every = sorted([(KINDS.index(k), s, e, True) for k, s, e in ruled] + [(KINDS.index(k), s, e, False) for k, s, e in more])
                rows.append([{"kind": KINDS[k], "start": s, "end": e, "text": text[s:e], "rule": rule} for k, s, e, rule in every])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind_of_spans)], names=["all", "spans"])

    return packed.mapInArrow(run, schema).select("all.*", "spans")


def masked(text: str | None, spans) -> str | None:
    """The text with every span replaced by its kind in brackets; of overlapping ones the first stands for all."""
    if text is None:
        return None
    out, at = [], 0
    for span in sorted(() if spans is None else spans, key=lambda s: (s["start"], -s["end"])):
        if span["start"] >= at:
            out += [text[at : span["start"]], f"[{span['kind'].upper()}]"]
        at = max(at, span["end"])
    return "".join([*out, text[at:]])


def mask_documents(df: DataFrame, model: SemiCrf | None, text_col: str = "text", sure: float = SURE) -> DataFrame:
    """``df`` with the personal data of its texts masked."""
    hide = F.pandas_udf(lambda texts, spans: pd.Series([masked(t, s) for t, s in zip(texts, spans)], dtype=object), "string")
    return find_spans(df, model, text_col, sure).withColumn(text_col, hide(F.col(text_col), F.col("spans"))).drop("spans")


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_email, n_ip, n_card and n_phone count the rules' spans, n_added those of the field; ``spans`` has both."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_spans(docs, fit(docs), keep_text=False)
    ruled = F.filter("spans", lambda s: s["rule"])

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter(ruled, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, KINDS), F.sha2(listed(ruled), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size(ruled)).cast("long").alias("n_added"),
    )
