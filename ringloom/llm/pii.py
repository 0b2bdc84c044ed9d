"""Personal data by patterns and by a linear-chain conditional random field.

The patterns find addresses, numbers and the like as they are usually written. The random field finds what they miss: bracketed
mail addresses, phone numbers without a plus, cards and addresses with unusual separators, and secrets (passwords, keys, tokens), for
which there is no pattern. It is trained on a small labelled table, over features of word shapes, and decoded by Viterbi in numpy batches.

A word can only carry a label if it has a digit, an @, a bracketed "at" or "dot" or the name of a secret in front of = or :, or stands beside
such a bracket. All other words are O by definition, so the chain falls apart into short runs of open words; decoding these is decoding
the whole text. A span that the field adds must pass the check of its kind and must not touch a span of the patterns. All steps take time
in proportion to the text, but for a logarithm.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: What spans can be: the kinds of the patterns, and what only the field finds.
ALL_KINDS = (*KINDS, "secret")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match that could start inside a run of digits could start at the run's first digit, so only these are tried.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def valid(kind: str, text: str) -> bool:
    if kind == "ip":
        return all(len(p) <= 3 and int(p or "0") <= 255 for p in (p.lstrip("0") for p in re.findall("[0-9]+", text)))  # int() refuses very long runs
    digits = "".join(_DIGIT.findall(text))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of each kind that do not overlap within the kind, by kind and start."""
    out: list[Span] = []
    if "@" in text:
        # nothing before an @ but its local part can start a match, so each @ is tried with the longest local part
        end, at = 0, text.find("@")
        while at >= 0:
            start = at
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            m = _DOMAIN.match(text, at + 1) if start < at else None
            if m:
                out.append(("email", start, m.end()))
                end = m.end()
            at = text.find("@", max(at + 1, end))
    if not _DIGIT.search(text):
        return out
    for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
        if kind != "phone" or "+" in text:
            out += [(kind, *m.span()) for m in pattern.finditer(text) if valid(kind, m[0])]
    return out


# --- the random field -------------------------------------------------------------------------------------------

LABELS = ("O", *(f"{p}-{k}" for k in ALL_KINDS for p in "BI"))
_AT, _DOT = re.compile(r"[\[({<]at[\])}>]", re.I), re.compile(r"[\[({<](?:dot|\.)[\])}>]", re.I)
#: Names of secrets, fixed.
_NAMES = r"passwd|password|passphrase|pwd|pin|secret|token|bearer|credential|api_?key|access_?key|private_?key|auth_?key|key"
_OPEN = re.compile(r"[0-9@]|[=:](?=\S)|[\[({<](?i:at|dot)[\])}>]")
_NAMED = re.compile(rf"(?:^|[^a-z])(?:{_NAMES})s?[\"']?$", re.I)
#: Cells (runs times words of the longest) of a batch of the decoder.
CELLS = 1 << 15
_WORD = re.compile(r"\S+")
_FORBIDDEN = -1e4


def _allowed() -> np.ndarray:
    """Transition scores that no training changes: I follows B or I of its kind."""
    out = np.zeros((len(LABELS), len(LABELS)))
    for j, to in enumerate(LABELS):
        if to[0] == "I":
            for i, of in enumerate(LABELS):
                if of[2:] != to[2:] or of == "O":
                    out[i, j] = _FORBIDDEN
    return out


ALLOWED = _allowed()


def word_features(words: list[str], i: int) -> list[str]:
    """Features of word ``i``: its shape, its counts, and what stands beside it."""
    w = words[i]
    digits = sum(c.isdigit() for c in w)
    shape = re.sub(r"(.)\1+", r"\1", "".join("9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in w.rstrip(".,;:!?"))[:40])
    before = words[i - 1].strip(".,;:!?()[]").lower() if i else ""
    value = w.rstrip(".,;:!?").strip("\"'`<>()")
    cut = max(value.rfind("="), value.rfind(":")) + 1
    named = value[: cut - 1] if cut else words[i - 1].rstrip("=:") if i and words[i - 1][-1] in "=:" and len(words[i - 1]) > 1 else words[i - 2] if i > 1 and words[i - 1] in ("=", ":", ":=", "=>", "is") else ""
    value = value[cut:]
    out = ["bias", f"shape={shape[:16]}", f"digits={min(digits, 20)}", f"long={min(len(w), 24) // 4}", f"before={before if before.isalpha() else '9' if before else ''}"]
    for name, hit in (("at", "@" in w), ("bracket_at", _AT.search(w)), ("bracket_dot", _DOT.search(w)), ("letters", any(c.isalpha() for c in w)), ("all_digits", digits == len(w)), ("plus", w[0] == "+"), ("hex", re.fullmatch(r"[0-9a-f]{16,}", value)), ("named", named and _NAMED.search(named)), ("quoted", w[0] in "\"'`"), ("mixed", len(value) > 15 and any(c.isdigit() for c in value) and any(c.isalpha() for c in value)), ("capitals", re.fullmatch(r"(?=.*[A-Z])[A-Z0-9]{16,}", value)), ("varied", len(value) > 15 and len(set(value)) > 9)):
        if hit:
            out.append(name)
    for name, j in (("next", i + 1), ("prev", i - 1)):
        near = words[j] if 0 <= j < len(words) else ""
        out.append(f"{name}_digits={min(sum(c.isdigit() for c in near), 8)}")
        if _AT.search(near):
            out.append(f"{name}_at")
        if _DOT.search(near):
            out.append(f"{name}_dot")
    return out


def open_runs(text: str) -> Iterator[list[tuple[int, int]]]:
    """Maximal runs of open words of one line, each as [start, end) offsets, preceded by the word before (for features)."""
    hits, at, last, last_start = [], 0, -1, 0
    for m in _OPEN.finditer(text):
        if m.start() < at:
            continue
        start = m.start()
        while start > max(at, last) and not text[start - 1].isspace():
            start -= 1
        if start == last:  # in the word of the hit before
            start = last_start
        last, last_start = m.start(), start
        if m[0] in "=:" and not _NAMED.search(text[max(start, last - 24) : last]):
            continue
        word = _WORD.match(text, start)
        at = word.end()
        hits.append(word.span())
    words: list[tuple[int, int]] = []
    for s, e in hits:
        group = [(s, e)]
        if _AT.search(text, s, e) or _DOT.search(text, s, e):  # its neighbours are open too
            group = [*_before(text, s), (s, e), *_after(text, e)]
        for w in group:
            if not words or w[0] >= words[-1][1]:
                words.append(w)
    run: list[tuple[int, int]] = []
    for w in words:
        if run and (text[run[-1][1] : w[0]].strip() or "\n" in text[run[-1][1] : w[0]]):
            yield run
            run = []
        run.append(w)
    if run:
        yield run


def _before(text: str, at: int) -> list[tuple[int, int]]:
    end = at
    while end and text[end - 1] in " \t":
        end -= 1
    start = end
    while start and not text[start - 1].isspace():
        start -= 1
    return [(start, end)] if start < end else []


def _after(text: str, at: int) -> list[tuple[int, int]]:
    while at < len(text) and text[at] in " \t":
        at += 1
    m = _WORD.match(text, at)
    return [m.span()] if m else []


def labelled_table(rows: int = 1000, seed: int = 7) -> list[tuple[str, list[Span]]]:
    """The small labelled table: sentences with the spans in them, filled from templates by a seeded generator."""
    r = random.Random(seed)
    of = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    d = lambda n: of("0123456789", n)
    low, cap = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    name = lambda: r.choice(["anna", "j.smith", "maria_lopez", "kurt.w", "info", "p.dupont", "lee42", "sales"])
    host = lambda: r.choice(["example", "mail7", "acme", "uni-bonn", "corp"])
    end = lambda: r.choice(["com", "org", "de", "fr", "es", "net"])

    def card(sep: str) -> str:
        body = r.choice("345") + d(14)
        full = next(body + c for c in "0123456789" if luhn(body + c))
        return sep.join(full[i : i + 4] for i in range(0, 16, 4))

    def secret() -> str:
        return r.choice([lambda: of("0123456789abcdef", r.choice([24, 32, 40, 48, 64])), lambda: of(low + cap + "0123456789", r.randint(18, 44)), lambda: of(cap + "0123456789", r.randint(16, 24)), lambda: f"{of(low, 2)}_{of(low, 4)}_{of(low + cap + '0123456789', 24)}", lambda: of(low + cap + "0123456789+/", 40)])()

    def short() -> str:
        return of(low, r.randint(3, 8)) + r.choice(["", of("!$#%&_", 1)]) + d(r.randint(1, 5))

    called = lambda: r.choice(["password", "passwd", "pwd", "secret", "token", "key", "api_key", "apikey", "API_KEY", "access_key", "PASSWORD", "auth_key", "client_secret"])
    quoted = lambda x: r.choice(["{}", "{}", "'{}'", '"{}"', '"{}"']).format(x)
    made = {
        "email": [lambda: f"{name()} [at] {host()} [dot] {end()}", lambda: f"{name()} (at) {host()} (dot) {end()}", lambda: f"{name()}[at]{host()}[dot]{end()}", lambda: f"{name()}(at){host()}.{end()}", lambda: f"{name()} [at] {host()}.{end()}", lambda: f"{name()}@{host()}"],
        "ip": [lambda: f"{r.randint(1, 255)}[.]{r.randint(0, 255)}[.]{r.randint(0, 255)}[.]{r.randint(0, 255)}", lambda: f"{r.randint(1, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)}[.]{r.randint(0, 255)}"],
        "card": [lambda: card("."), lambda: card("/"), lambda: card("_")],
        "phone": [lambda: f"({d(3)}) 555-{d(4)}", lambda: f"{d(3)}-555-{d(4)}", lambda: f"{d(3)}.555.{d(4)}", lambda: f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", lambda: f"0{d(3)}/{d(7)}", lambda: f"00{d(2)} {d(3)} {d(7)}"],
        "secret": [lambda: quoted(secret()), lambda: secret()],
    }
    hash_of = lambda: of("0123456789abcdef", r.choice([7, 8, 12]))
    other = [lambda: d(4), lambda: f"{d(2)}.{d(2)}.20{d(2)}", lambda: f"20{d(2)}-{d(2)}-{d(2)}", lambda: f"{d(1)}.{d(1)}.", lambda: f"{d(2)},{d(3)}.{d(2)}", lambda: d(16), lambda: d(10), lambda: f"{d(2)}:{d(2)}", lambda: f"v{d(1)}.{d(2)}", lambda: f"#{d(5)}", lambda: f"{d(2)}%", lambda: f"{d(3)} {d(3)}", lambda: f"ISBN {d(3)}-{d(1)}-{d(5)}-{d(3)}-{d(1)}", lambda: f"[{d(1)}]", lambda: f"({d(4)})", lambda: f"{d(3)}-{d(2)}", lambda: f"{d(1)} {d(1)} {d(1)} {d(1)}", lambda: "@ noon", lambda: "@anna", lambda: f"commit {hash_of()}", lambda: f"https://{host()}.{end()}/{of(low, 9)}/{d(4)}/{of(low, 14)}-{d(2)}", lambda: f"{of(low, 9)}_{of(low, 8)}_{d(2)}.{r.choice(['csv', 'txt', 'py'])}", lambda: f"{of(cap, 3)}-{d(5)}", lambda: f"{of(low, 12)}{d(1)}{of(low, 8)}", lambda: f"key {d(1)}", lambda: f"token {d(2)} of {d(3)}", lambda: f"the key: {d(1)}", lambda: f"{of(cap, r.randint(8, 17))}!{d(2)}"]
    lead = {"email": ["write to", "mail", "contact:", "reach", ""], "ip": ["host", "from", "server", ""], "card": ["card", "visa", "paid with", ""], "phone": ["call", "tel", "phone:", "fax", ""], "secret": ["export", "set", "use", ""]}
    words = "the of und der les que and ering tion ment are from".split()
    out = []
    for i in range(rows):
        text, spans = " ".join(r.choices(words, k=r.randint(0, 4))), []
        for _ in range(r.randint(1, 2)):
            if i % 2:
                kind = r.choice(ALL_KINDS)
                text = f"{text} {r.choice(lead[kind])}".strip()
                item = r.choice(made[kind])()
                if kind == "secret":
                    text = f"{text} {r.choice(['', '', f'{called()} =', f'{called()}:', f'{called()} :', f'{called()} is'])}".strip()
                    if r.random() < 0.3:
                        item = f"{called()}{r.choice('=:')}{quoted(r.choice([secret, short])())}"
                    elif text and text[-1] in "=:":
                        item = quoted(r.choice([secret, secret, short])())
                at = len(text) + bool(text)
                spans.append((kind, at, at + len(item)))
            else:
                item = r.choice(other)()
            text = f"{text} {item}".strip() + r.choice(["", "", ".", ","]) + " " + " ".join(r.choices(words, k=r.randint(1, 4)))
        out.append((text, [(k, *_trimmed(k, text, s, e)) if k == "secret" else (k, s, e) for k, s, e in spans]))
    return out


class Field:
    """Weights by feature name and label, and transition scores."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, moves: np.ndarray, start: np.ndarray):
        self.names, self.weights, self.moves, self.start = names, weights, moves, start
        self.seen: dict[tuple, np.ndarray] = {}

    def emissions(self, text: str, run: list[tuple[int, int]]) -> np.ndarray:
        words = run_words(text, run)
        rows = []
        for i in range(len(words) - len(run), len(words)):
            at = [k for f in word_features(words, i) if (k := self.names.get(f)) is not None]
            rows.append(self.weights[at].sum(axis=0))
        return np.array(rows)

    def decode(self, emissions: list[np.ndarray]) -> list[np.ndarray]:
        """Viterbi over many runs at once: runs of like length form a batch."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(emissions)
        order = sorted(range(len(emissions)), key=lambda i: -len(emissions[i]))
        at = 0
        while at < len(order):
            rows = order[at : at + max(1, CELLS // max(1, len(emissions[order[at]])))]
            at += len(rows)
            lengths = np.array([len(emissions[i]) for i in rows])
            score = np.stack([emissions[i][0] for i in rows]) + self.start
            back = np.zeros((int(lengths[0]), len(rows), len(LABELS)), np.int8)
            last = score.copy()
            for t in range(1, int(lengths[0])):
                n = int((lengths > t).sum())  # the longer runs come first
                step = score[:n, :, None] + self.moves[None]
                back[t, :n] = step.argmax(axis=1)
                score[:n] = step.max(axis=1) + np.stack([emissions[i][t] for i in rows[:n]])
                last[:n] = score[:n]
            for k, i in enumerate(rows):
                path = np.zeros(lengths[k], np.int64)
                path[-1] = last[k].argmax()
                for t in range(lengths[k] - 1, 0, -1):
                    path[t - 1] = back[t, k, path[t]]
                out[i] = path
        return out


def run_words(text: str, run: list[tuple[int, int]]) -> list[str]:
    """The words of the run after up to two words before it."""
    one = _before(text, run[0][0])
    return [text[s:e] for s, e in [*(_before(text, one[0][0]) if one else []), *one, *run]]


def train(table: list[tuple[str, list[Span]]], rounds: int = 150, rate: float = 0.3, decay: float = 0.01) -> Field:
    """Maximum likelihood with a quadratic penalty, by AdaGrad over full forward-backward passes."""
    names: dict[str, int] = {}
    runs, gold = [], []
    for text, spans in table:
        for run in open_runs(text):
            words = run_words(text, run)
            runs.append([[names.setdefault(f, len(names)) for f in word_features(words, i)] for i in range(len(words) - len(run), len(words))])
            gold.append([next((LABELS.index(("B-" if s <= a else "I-") + kind) for kind, a, b in spans if s < b and e > a), 0) for s, e in run])
    order = sorted(range(len(runs)), key=lambda i: -len(runs[i]))  # the runs that go on at step t are the first ones
    runs, gold = [runs[i] for i in order], [gold[i] for i in order]
    n, longest = len(runs), len(runs[0])
    length = np.array([len(r) for r in runs])
    going = [int((length > t).sum()) for t in range(longest)]
    real = np.arange(longest)[None] < length[:, None]
    x = np.zeros((int(length.sum()), len(names)))  # a row for each word, in the order of ``real``
    y = np.zeros((n, longest, len(LABELS)))
    for row, f in zip(x, (f for r in runs for f in r), strict=True):
        row[f] = 1
    for i, r in enumerate(gold):
        y[i, np.arange(len(r)), r] = 1
    mask = real[..., None]
    w, moves, start = np.zeros((len(names), len(LABELS))), np.zeros_like(ALLOWED), np.zeros(len(LABELS))
    never = np.array([_FORBIDDEN if k[0] == "I" else 0.0 for k in LABELS])
    squares = [np.full_like(p, 1e-6) for p in (w, moves, start)]
    seen = np.einsum("nti,ntj->ij", y[:, :-1], y[:, 1:])
    lse = lambda a, axis: (m := a.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis=axis))
    for _ in range(rounds):
        e, tr = np.zeros_like(y), moves + ALLOWED
        e[real] = x @ w
        fwd, bwd = np.zeros_like(e), np.zeros_like(e)
        fwd[:, 0] = e[:, 0] + start + never
        for t in range(1, longest):
            k = going[t]
            fwd[:k, t] = lse(fwd[:k, t - 1, :, None] + tr, 1) + e[:k, t]
        for t in range(longest - 2, -1, -1):
            k = going[t + 1]
            bwd[:k, t] = lse(tr[None] + (e[:k, t + 1] + bwd[:k, t + 1])[:, None, :], 2)
        z = lse(fwd[np.arange(n), length - 1], 1)[:, None]
        p = np.exp(np.minimum(fwd + bwd - z[..., None], 0)) * mask
        pairs = np.zeros_like(moves)
        for t in range(1, longest):
            k = going[t]
            pairs += np.exp(np.minimum(fwd[:k, t - 1, :, None] + tr + (e[:k, t] + bwd[:k, t])[:, None, :] - z[:k, :, None], 0)).sum(axis=0)
        grads = [x.T @ (y - p)[real] - decay * w, seen - pairs - decay * moves, (y[:, 0] - p[:, 0]).sum(axis=0) - decay * start]
        for value, g, s in zip((w, moves, start), grads, squares, strict=True):
            s += g * g
            value += rate * g / np.sqrt(s)
    return Field(names, w, moves + ALLOWED, start + never)


@lru_cache(maxsize=1)
def default_field() -> Field:
    return train(labelled_table())


class _Covered:
    """Whether a stretch touches one of the spans: by bisection in their starts and the furthest end so far."""

    def __init__(self, spans: list[Span]):
        order = sorted((a, b) for _, a, b in spans)
        self.starts, self.ends = [a for a, _ in order], list(itertools.accumulate((b for _, b in order), max))

    def __call__(self, s: int, e: int) -> bool:
        i = bisect.bisect_left(self.starts, e)
        return bool(i) and self.ends[i - 1] > s


def added_spans(texts: list[str], base: list[list[Span]], field: Field) -> list[list[Span]]:
    """What the field finds beside the base spans: checked, free of overlaps, without the punctuation around it."""
    covered = [_Covered(b) for b in base]
    where = [(i, run) for i, t in enumerate(texts) for run in open_runs(t) if not all(covered[i](s, e) for s, e in run)]
    out: list[list[Span]] = [[] for _ in texts]
    for (i, run), path in zip(where, field.decode([field.emissions(texts[i], run) for i, run in where]), strict=True):
        at = 0
        while at < len(path):
            label = LABELS[path[at]]
            end = at + 1
            if label[0] == "B":
                while end < len(path) and LABELS[path[end]] == f"I-{label[2:]}":
                    end += 1
                s, e = _trimmed(label[2:], texts[i], run[at][0], run[end - 1][1])
                if _plausible(label[2:], texts[i][s:e]) and not covered[i](s, e):
                    out[i].append((label[2:], s, e))  # runs and their words ascend, so additions don't overlap
            at = end
    return out


def _trimmed(kind: str, text: str, s: int, e: int) -> tuple[int, int]:
    """Without punctuation around it; a secret also without its name and quotes."""
    after, before = (".,;:!?\"'`#$%&*)>", "\"',;:`(<") if kind == "secret" else (".,;:!?\"'", "\"',;:")
    while e > s and text[e - 1] in after:
        e -= 1
    named = re.match(rf"[\"']?[\w-]*(?:{_NAMES})[\"']?[=:]", text[s:e], re.I) if kind == "secret" else None
    s += named.end() if named else 0
    while s < e and text[s] in before:
        s += 1
    return s, e


def _plausible(kind: str, text: str) -> bool:
    if kind == "secret":
        return len(text) >= 4 and not any(c.isspace() for c in text)
    if kind == "email":
        return bool(_AT.search(text) or re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]*[A-Za-z0-9]", text))
    if kind == "ip" and len(re.findall("[0-9]+", text)) != 4:
        return False
    letters = any(c.isalpha() for c in text)
    return not letters and valid(kind, text)


def find(texts: list[str], field: Field | None = None) -> list[tuple[list[Span], list[Span]]]:
    """(base, all) spans of each whole text; all are ordered by kind, then start."""
    base = [base_spans(t) for t in texts]
    more = added_spans(texts, base, field or default_field())
    return [(b, sorted(b + m, key=lambda s: (ALL_KINDS.index(s[0]), s[1]))) for b, m in zip(base, more, strict=True)]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redact(text: str, spans: list[Span]) -> str:
    """Each stretch that spans cover becomes the tag of its first span."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"<{kind.upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def _batches(batches: Iterator[pa.RecordBatch], make) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows, size = [], 0
        for row in zip(*b.columns, strict=True):
            row = [x.as_py() for x in row]
            rows.append(row)
            size += len(row[1] or "")
            if size > 1 << 21:
                yield make(rows)
                rows, size = [], 0
        yield make(rows)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each input row: id, counts of the base spans, their digest, and all spans as text (kind:start:end by ALL_KINDS, then start).

    A null text is empty; equal ids and equal texts are rows of their own; a null id stays null; other columns are not read; no
    rows give no rows. Nothing is shuffled.
    """
    field = default_field()
    fields = pa.schema([(id_col, pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])

    def make(rows: list) -> pa.RecordBatch:
        found = find([t or "" for _, t in rows], field)
        counts = [[sum(s[0] == k for s in base) for base, _ in found] for k in KINDS]
        digests = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([[i for i, _ in rows], *counts, digests, [joined(x) for _, x in found]], fields.types, strict=True)], schema=fields)

    schema = f"{id_col} long, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string"
    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(lambda it: _batches(it, make), schema)


def redacted(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with the spans of each whole text replaced by tags, and its length (code points) put right. A null text stays null."""
    field = default_field()
    names = docs.columns
    k = names.index(text_col)
    schema = docs.select(*names).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(k).to_pylist()
            at = 0
            while at < len(texts) or not len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end] or "") <= 1 << 21):
                    size += len(texts[end] or "")
                    end += 1
                part = b.slice(at, end - at)
                found = find([t or "" for t in texts[at:end]], field)
                new = [None if t is None else redact(t, spans) for t, (_, spans) in zip(texts[at:end], found, strict=True)]
                columns = list(part.columns)
                columns[k] = pa.array(new, pa.string())
                if length_col in names:
                    j = names.index(length_col)
                    columns[j] = pa.array([None if t is None else len(t) for t in new], columns[j].type)
                yield pa.RecordBatch.from_arrays(columns, names=names)
                at = end
                if not len(texts):
                    break

    return docs.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
