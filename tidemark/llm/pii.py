"""Personal data in whole texts: fixed patterns, and a linear-chain conditional random field that adds to them.

The patterns find e-mail addresses, IP addresses, card numbers and telephone numbers; a match that
fails its check is dropped. The field labels tokens that hold a digit or an at sign; words that hold
neither are never personal data here, so each run of such tokens between words is a chain of its own
and is decoded exactly. It is trained on the driver from a small labelled table and decoded by
Viterbi in numpy over many chains at once. What it adds has to pass the same checks (digits, Luhn,
parts of an address) and to touch no span of the patterns.

Defined results: null text is empty; an empty text has no spans; repeated rows have equal results;
any id type, nulls included, is passed through; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

KINDS = ("email", "ip", "card", "phone")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Any match of a pattern lies within one run of its characters, and these hold few of a text's.
_EMAIL_RUN = re.compile(r"[A-Za-z0-9._%+@-]++")
_DIGIT_RUN = re.compile(r"[0-9+][0-9\x20().+-]*+")
#: What follows an at sign, and chains of digits with single dots between: read once, without going back.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")

Span = tuple[str, int, int]


def digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _is_ip(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def _is_card(s: str) -> bool:
    return 14 <= len(d := digits(s)) <= 19 and luhn(d)


def _is_phone(s: str) -> bool:
    return 10 <= len(digits(s)) <= 15


def _emails(text: str, lo: int, hi: int) -> Iterator[Span]:
    """Matches of the e-mail pattern within a run of its characters, found from the at signs: linear in the run."""
    free, at = lo, text.find("@", lo, hi)  # what is before `free` belongs to a match or to another at sign
    while at >= 0:
        if at > free and (m := _DOMAIN.match(text, at + 1, hi)):
            yield "email", free, m.end()
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", at + 1, hi)


def _addresses(text: str, lo: int, hi: int) -> Iterator[Span]:
    """Matches of the IP pattern whose parts are at most 255: every four neighbours of a dotted chain."""
    for m in _DOTTED.finditer(text, lo, hi):
        parts = m[0].split(".")
        a = m.start()
        for i in range(0, len(parts) - 3, 4):
            own = ".".join(parts[i : i + 4])
            if _is_ip(own):
                yield "ip", a, a + len(own)
            a += len(own) + 1


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns, by start and then kind. Takes time in proportion to the text."""
    out: list[Span] = []
    if "@" in text:
        for run in _EMAIL_RUN.finditer(text):
            if "@" in run[0]:
                out += _emails(text, *run.span())
    for run in _DIGIT_RUN.finditer(text):
        lo, hi = run.span()
        if hi - lo < 7:
            continue
        s = run[0]
        if s.count(".") >= 3:
            out += _addresses(text, lo, hi)
        if hi - lo >= 14:
            out += [("card", *m.span()) for m in _CARD.finditer(text, lo, hi) if _is_card(m[0])]
        if "+" in s:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text, lo, hi) if _is_phone(m[0])]
    return in_order(out)


def in_order(spans: Iterable[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def written(spans: Iterable[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# ---- the conditional random field ----

LABELS = ("O", "email", "ip", "card", "card+", "phone", "phone+")
#: From a token's first digit or at sign to its end.
_MARKED = re.compile(r"[0-9@]\S*")
_TRIM_LEFT, _TRIM_RIGHT = "\"'<[{,;:", "\"'>]},;:.!?"


def chains(text: str) -> Iterator[list[tuple[int, int, str]]]:
    """Runs of neighbouring tokens with a digit or an at sign: (start, end, word before the token)."""
    run: list[tuple[int, int, str]] = []
    end = 0
    for m in _MARKED.finditer(text):
        a, b = m.span()
        while a > end and not text[a - 1].isspace():
            a -= 1
        first = a
        gap = text[end:a] if run else ""
        if run and (len(gap) > 2 or gap.strip() or "\n" in gap):
            yield run
            run = []
        end = b
        while a < b and text[a] in _TRIM_LEFT:
            a += 1
        while b > a and text[b - 1] in _TRIM_RIGHT:
            b -= 1
        before = "" if run else text[max(0, first - 24) : first].rstrip().rpartition(" ")[2].strip(".,:;!?\"'()").lower()
        if a < b:
            run.append((a, b, before))
    if run:
        yield run


def features(token: str, before: str, first: bool, last: bool) -> tuple[str, ...]:
    """Word-shape features of a token."""
    shape = re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", lambda m: f"<{min(len(m[0]), 9)}>", token))[:40]
    d = digits(token)
    out = [f"shape={shape}", f"digits={len(d)}", f"before={before}" if len(before) < 12 else "before", f"ends={first:d}{last:d}"]
    if d and len(d) == len(token):
        out.append("all digits")
    if 13 <= len(d) <= 19 and not re.search(r"[^\W\d_]|@", token):
        out.append(f"luhn={luhn(d):d}")
    out.append(f"at={token.count('@'):d} dots={min(token.count('.'), 4)}")
    if re.search(r"[^\W\d_]", token):
        out.append("letters")
    return tuple([*out, *(f"has {c}" for c in "+()-/=:%$_" if c in token)])


class Field:
    """A linear-chain conditional random field over hashed-by-name features."""

    def __init__(self, names: dict[str, int], unary: np.ndarray, pair: np.ndarray):
        self.names, self.unary, self.pair = names, unary, pair

    def scores(self, tokens: list[tuple[str, ...]]) -> np.ndarray:
        out = np.zeros((len(tokens), len(LABELS)))
        for i, t in enumerate(tokens):
            out[i] = self.unary[[self.names[x] for x in t if x in self.names]].sum(axis=0)
        return out

    @classmethod
    def fit(cls, rows: list[tuple[str, list[Span]]], rounds: int = 150, rate: float = 0.5, decay: float = 1e-4) -> Field:
        """Maximum likelihood by AdaGrad on the whole table; start and goal are the same every time."""
        seqs, golds = [], []
        for text, spans in rows:
            for run in chains(text):
                seqs.append([features(text[a:b], w, i == 0, i == len(run) - 1) for i, (a, b, w) in enumerate(run)])
                golds.append([gold(a, b, spans) for a, b, _ in run])
        names = {x: i for i, x in enumerate(dict.fromkeys(x for s in seqs for t in s for x in t))}
        n, most, k = len(seqs), max(map(len, seqs)), len(LABELS)
        tokens = [(i, t, names[x]) for i, s in enumerate(seqs) for t, own in enumerate(s) for x in own]
        row, at, col = (np.array(x) for x in zip(*tokens))
        y, mask = np.zeros((n, most), int), np.zeros((n, most), bool)
        for i, g in enumerate(golds):
            y[i, : len(g)], mask[i, : len(g)] = g, True
        unary, pair = np.zeros((len(names), k)), np.zeros((k, k))
        seen_u, seen_p = np.full_like(unary, 1e-8), np.full_like(pair, 1e-8)
        truth = np.eye(k)[y] * mask[..., None]
        for _ in range(rounds):
            e = np.zeros((n, most, k))
            np.add.at(e, (row, at), unary[col])
            p, q = _marginals(e, pair, mask)
            gap = truth - p
            gu = np.zeros_like(unary)
            np.add.at(gu, col, gap[row, at])
            both = mask[:, 1:] & mask[:, :-1]
            gp = np.einsum("nta,ntb->ab", truth[:, :-1] * both[..., None], truth[:, 1:]) - q
            gu, gp = gu - decay * n * unary, gp - decay * n * pair
            seen_u += gu**2
            seen_p += gp**2
            unary += rate * gu / np.sqrt(seen_u)
            pair += rate * gp / np.sqrt(seen_p)
        return cls(names, unary, pair)

    def decode(self, seqs: list[list[tuple[str, ...]]], most: int = 50_000) -> list[np.ndarray]:
        """The likeliest labels of each chain: Viterbi over chains of like length side by side."""
        out: list[np.ndarray] = [np.zeros(0, int)] * len(seqs)
        cache: dict[tuple[str, ...], np.ndarray] = {}
        order = sorted(range(len(seqs)), key=lambda i: len(seqs[i]))
        at = 0
        while at < len(order):
            stop = at + 1
            while stop < len(order) and len(seqs[order[stop]]) * (stop + 1 - at) <= most:
                stop += 1
            own = order[at:stop]
            length = np.array([len(seqs[i]) for i in own])
            e = np.zeros((len(own), int(length.max()), len(LABELS)))
            for r, i in enumerate(own):
                for t, x in enumerate(seqs[i]):
                    if x not in cache:
                        cache[x] = self.scores([x])[0]
                    e[r, t] = cache[x]
            best, back = e[:, 0], np.zeros(e.shape, np.int8)
            ends = [best]
            for t in range(1, e.shape[1]):
                reach = best[:, :, None] + self.pair
                back[:, t] = reach.argmax(axis=1)
                best = reach.max(axis=1) + e[:, t]
                ends.append(best)
            for r, i in enumerate(own):
                path = np.zeros(length[r], int)
                path[-1] = ends[length[r] - 1][r].argmax()
                for t in range(length[r] - 1, 0, -1):
                    path[t - 1] = back[r, t, path[t]]
                out[i] = path
            at = stop
        return out


def _marginals(e: np.ndarray, pair: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label marginals per token, and expected label pairs summed over all chains."""
    n, most, k = e.shape

    def lse(x: np.ndarray, axis: int) -> np.ndarray:
        m = x.max(axis=axis, keepdims=True)
        return np.log(np.exp(x - m).sum(axis=axis)) + m.squeeze(axis)

    fwd, bwd = np.zeros_like(e), np.zeros_like(e)
    fwd[:, 0] = e[:, 0]
    for t in range(1, most):
        step = lse(fwd[:, t - 1][:, :, None] + pair, 1) + e[:, t]
        fwd[:, t] = np.where(mask[:, t, None], step, fwd[:, t - 1])
    z = lse(fwd[:, -1], 1)
    for t in range(most - 2, -1, -1):
        step = lse(pair + (bwd[:, t + 1] + e[:, t + 1])[:, None, :], 2)
        bwd[:, t] = np.where(mask[:, t + 1, None], step, 0)
    p = np.exp(fwd + bwd - z[:, None, None]) * mask[..., None]
    q = np.zeros((k, k))
    for t in range(1, most):
        joint = np.exp(fwd[:, t - 1][:, :, None] + pair + (e[:, t] + bwd[:, t])[:, None, :] - z[:, None, None])
        q += (joint * mask[:, t, None, None]).sum(axis=0)
    return p, q


def gold(a: int, b: int, spans: list[Span]) -> int:
    for kind, lo, hi in spans:
        if lo <= a < hi or a <= lo < b:
            return LABELS.index(kind + "+" if a > lo and kind in ("card", "phone") else kind)
    return 0


def labelled_table(rows: int = 500, seed: int = 7) -> list[tuple[str, list[Span]]]:
    """A small labelled table, made by rule: words, personal data in many forms, and numbers that are none."""
    rng = np.random.default_rng(seed)
    pick = lambda x: x[int(rng.integers(len(x)))]
    num = lambda n: "".join(str(int(d)) for d in rng.integers(0, 10, n))
    words = "the of and a to in call me at card number tel phone mail write address server from host order page room year paid version was on code le de la der und en que".split()

    def card(groups: bool) -> str:
        body = pick("3456") + num(int(rng.integers(12, 17)))
        body += next(str(c) for c in range(10) if luhn(body + str(c)))
        sep = pick(" -") if groups else ""
        return sep.join(body[i : i + 4] for i in range(0, len(body), 4)) if groups else body

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        return pick([f"+1 ({a}) {b}-{c}", f"+{pick('123456')}{pick('123456')} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+1 {a} {b} {c}", f"+1-{a}-{b}-{c}"])

    def ip() -> str:
        return ".".join(str(int(x)) for x in rng.integers(0, 256, 4))

    def email() -> str:
        return f"{pick(words)}{pick(['', '.', '_'])}{num(int(rng.integers(0, 3)))}@{pick(words)}{num(1)}.{pick(['com', 'org', 'example.net'])}"

    def other() -> str:
        return pick([num(int(rng.integers(1, 9))), f"{num(4)}-{num(2)}-{num(2)}", f"v{num(1)}.{num(1)}.{num(2)}", f"{num(1)}.{num(2)}", f"${num(3)}.{num(2)}", f"{pick(words)}={num(4)}ab{num(3)}f", f"{num(2)}:{num(2)}", f"{num(2)}%", f"{pick(words)}{num(2)}", f"{num(3)},{num(3)}", f"{num(2)}/{num(2)}/{num(4)}", f"@{pick(words)}", f"id-{num(5)}", f"{num(12)}", f"{num(10)}", f"{num(20)}", f"{num(4)} {num(4)}", f"{num(1)}.{num(1)}.{num(1)}", f"#{num(3)}"])

    out = []
    for _ in range(rows):
        text, spans = "", []
        for _ in range(int(rng.integers(2, 7))):
            text += "".join(pick(words) + " " for _ in range(int(rng.integers(0, 5))))
            kind = pick(["other", "other", "email", "ip", "card", "phone"])
            what = {"other": other, "email": email, "ip": ip, "phone": phone, "card": lambda: card(rng.random() < 0.4)}[kind]()
            if kind != "other":
                spans.append((kind, len(text), len(text) + len(what)))
            text += what + pick([" ", " ", ". ", ", "])
        out.append((text, spans))
    return out


_CHECK = {"email": lambda s: bool(_EMAIL.fullmatch(s)), "ip": lambda s: bool(_IP.fullmatch(s)) and _is_ip(s), "card": _is_card, "phone": _is_phone}


def _reach(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Starts of spans (sorted), and how far the spans up to each of them reach."""
    return [a for _, a, _ in spans], list(accumulate((b for _, _, b in spans), max))


def added_spans(texts: list[str], base: list[list[Span]], field: Field) -> list[list[Span]]:
    """What the field finds in each text besides its base spans, and passes the check of its kind."""
    where, seqs = [], []
    reach = [_reach(b) for b in base]
    for i, text in enumerate(texts):
        starts, ends = reach[i]
        for run in chains(text):
            if starts and all((k := bisect_right(starts, a)) and ends[k - 1] >= b for a, b, _ in run):
                continue  # all of it is known
            where.append((i, run))
            seqs.append([features(text[a:b], w, k == 0, k == len(run) - 1) for k, (a, b, w) in enumerate(run)])
    out: list[list[Span]] = [[] for _ in texts]
    for (i, run), path in zip(where, field.decode(seqs)):
        found: list[list] = []
        for (a, b, _), y in zip(run, path):
            label = LABELS[y]
            if label.endswith("+") and found and found[-1] and found[-1][0] == label[:-1]:
                found[-1][2] = b
            elif label == "O":
                found.append([])
            else:
                found.append([label.rstrip("+"), a, b])
        for kind, a, b in filter(None, found):
            while kind != "phone" and a < b and texts[i][a] in "(":
                a += 1
            while a < b and texts[i][b - 1] in "()":
                b -= 1
            starts, ends = reach[i]
            k = bisect_left(starts, b)
            if _CHECK[kind](texts[i][a:b]) and not (k and ends[k - 1] > a):
                out[i].append((kind, a, b))
    return out


def find(docs: DataFrame, redact: bool = False) -> DataFrame:
    """doc_id, counts per kind, base_sha256 and spans of every row; with redact, docs with spans masked.

    redact replaces each span by its kind in brackets and sets n_chars, where there is one, to the
    new text's length; overlapping spans are masked as one, named after the first.
    """
    spark = docs.sparkSession
    field = spark.sparkContext.broadcast(Field.fit(labelled_table()))

    def spans_of(texts: list[str]) -> tuple[list[list[Span]], list[list[Span]]]:
        base = [base_spans(t) for t in texts]
        return base, [in_order([*b, *a]) for b, a in zip(base, added_spans(texts, base, field.value))]

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                yield batch.slice(at, 512)

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            base, spans = spans_of([t or "" for t in batch.column(1).to_pylist()])
            counts = [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in KINDS]
            sums = [hashlib.sha256(written(b).encode()).hexdigest() for b in base]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(sums, pa.string()), pa.array([written(s) for s in spans], pa.string())], names=names)
        common.tidy()

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            masked = [t and masked_text(t, s) for t, s in zip(texts, spans_of([t or "" for t in texts])[1])]
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(masked, batch.schema.field(at).type))
        common.tidy()

    if redact:
        out = common.text_batches(docs).mapInArrow(mask, docs.schema)
        kind = dict(docs.dtypes).get("n_chars")
        return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind)) if kind else out
    schema = common.schema_with(docs, "doc_id", n_email="long", n_ip="long", n_card="long", n_phone="long", base_sha256="string", spans="string")
    names = schema.names
    return common.text_batches(docs.select("doc_id", "text")).mapInArrow(report, schema)


def masked_text(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])
