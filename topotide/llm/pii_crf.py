"""Personal data: patterns, and a linear-chain CRF over word shapes.

The patterns give the base spans.  The CRF is trained from a small labelled
table and finds what the patterns miss or reject, such as numbers with a wrong
check digit or without the plus sign.  Every kind has a digit or an at sign,
so chains are built around the words that have one; all other text is outside
any chain, and the cost of decoding follows the number of such words.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topotide.llm.tables import table, text_of

KINDS = ("email", "ip", "card", "phone")
#: Tags of a word: outside, and begin and inside of each kind.
TAGS = ["O", *[f"{p}-{k}" for k in KINDS for p in "BI"]]
T = len(TAGS)
#: A number with more digits than a card has is more than one.
CARD_DIGITS = 19
#: Words on either side of a chain's marked words that belong to the chain.
MARGIN = 1

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match never starts inside a run of digits, since the run's start would match before; the lookbehind says so and keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]")
_SPACE = " \t\n\x0b\x0c\r"


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            done = m.end()
            yield start, done
            at = text.find("@", done)
        else:
            done = max(done, at + 1)  # the local part of a later match can't hold this sign
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns' matches that pass their checks, by kind as listed, then start."""
    spans = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            spans.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = re.sub("[^0-9]", "", m[0])
            if 13 <= len(digits) <= 19 and _luhn(digits):
                spans.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                spans.append(("phone", *m.span()))
    return spans


def chains(text: str) -> list[list[tuple[int, int]]]:
    """Chains of words, as (start, end): words with a digit or at sign and their neighbours; near ones share a chain."""
    out: list[list[tuple[int, int]]] = []
    n, done = len(text), -1

    def word_right(i: int) -> tuple[int, int] | None:
        while i < n and text[i] in _SPACE:
            i += 1
        if i >= n:
            return None
        e = i
        while e < n and text[e] not in _SPACE:
            e += 1
        return i, e

    def word_left(i: int, stop: int) -> tuple[int, int] | None:
        while i > stop and text[i - 1] in _SPACE:
            i -= 1
        if i <= stop:
            return None
        s = i
        while s > stop and text[s - 1] not in _SPACE:
            s -= 1
        return s, i

    m = _MARK.search(text)
    while m:
        start = m.start()
        while start > 0 and text[start - 1] not in _SPACE:
            start -= 1
        word = word_right(start)
        left: list[tuple[int, int]] = []
        i = start
        for _ in range(MARGIN):
            w = word_left(i, max(done, 0))
            if w is None:
                break
            left.insert(0, w)
            i = w[0]
        if out and left and left[0][0] <= done + 1 or out and not left and done >= 0:
            out[-1] += [*left, word]
        elif out and (left[0][0] if left else start) - done <= 1:
            out[-1] += [*left, word]
        else:
            out.append([*left, word])
        done = word[1]
        m = _MARK.search(text, done)
        right = word_right(done)
        if right and (m is None or m.start() >= right[1]):
            out[-1].append(right)
            done = right[1]
    return out


def shape(word: str) -> str:
    """The word with runs of letters as a or A, and runs of digits as 9 with their length up to 20."""
    s = re.sub(r"[0-9]+", lambda m: f"9{min(20, len(m[0]))}_", re.sub(r"[^\W\d_A-Z]+", "a", re.sub(r"[A-Z]+", "A", word)))
    return s[:40]


def word_features(word: str) -> list[str]:
    """Features of one word, from its shape alone."""
    core = word.strip(".,;:!?\"'|*#%$&()[]<>")
    n = sum(c.isdigit() for c in word)
    runs = re.findall(r"[0-9]+", core)
    kind = "plain" if n == 0 and "@" not in word else re.sub(r"[a-zA-Z]+", "a", re.sub(r"[0-9]+", "9", shape(core)))[:12]
    return [
        "core=" + (shape(core) if n or "@" in word else "a"),
        "kind=" + kind,
        f"digits={min(n, 20)}",
        f"runs={min(len(runs), 6)}:{max(map(len, runs), default=0)}",
        "at=" + ("2" if "@" in core[1:-1] and "." in core.rpartition("@")[2] else "1" if "@" in core else "0"),
        "dots=" + ("ip" if re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", core) else str(min(core.count("."), 4))),
        f"plus={core[:1] == '+'}",
        f"mixed={bool(re.search(r'[^\W\d_]', core)) and n > 0 and '@' not in core}",
        f"paren={bool(re.match(r'\(?[0-9]+\)?$', word)) and '(' in word}",
    ]


def chain_features(words: list[str]) -> list[list[str]]:
    """Features of each word of a chain: its own, and its neighbours' kinds."""
    own = [word_features(w) for w in words]
    out = []
    for i, f in enumerate(own):
        before = own[i - 1][1] if i else "kind=start"
        after = own[i + 1][1] if i + 1 < len(own) else "kind=end"
        out.append([*f, "before:" + before, "after:" + after, f"both:{before}|{f[1]}|{after}", "bias"])
    return out


class Crf:
    """Weights of features by tag, and of tag pairs."""

    def __init__(self, names: dict[str, int], emit: np.ndarray, move: np.ndarray):
        self.names, self.emit, self.move = names, emit, move

    def scores(self, rows: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(rows), T))
        for i, row in enumerate(rows):
            ids = [self.names[f] for f in row if f in self.names]
            if ids:
                out[i] = self.emit[ids].sum(axis=0)
        return out

    def decode(self, scores: list[np.ndarray]) -> list[list[int]]:
        """Viterbi over a batch of chains, those of like length together."""
        order = sorted(range(len(scores)), key=lambda i: len(scores[i]))
        out: list[list[int]] = [[] for _ in scores]
        for at in range(0, len(order), 256):
            part = order[at : at + 256]
            lengths = np.array([len(scores[i]) for i in part])
            longest = int(lengths.max(initial=0))
            s = np.zeros((len(part), longest, T))
            for r, i in enumerate(part):
                s[r, : len(scores[i])] = scores[i]
            best = s[:, 0] + self.move[T]
            back = np.zeros((len(part), longest, T), np.int8)
            for t in range(1, longest):
                step = best[:, :, None] + self.move[None, :T, :]
                back[:, t] = step.argmax(axis=1)
                new = step.max(axis=1) + s[:, t]
                best = np.where((t < lengths)[:, None], new, best)
            for r, i in enumerate(part):
                path = [int(best[r].argmax())]
                for t in range(lengths[r] - 1, 0, -1):
                    path.append(int(back[r, t, path[-1]]))
                out[i] = path[::-1]
        return out


def _allowed() -> np.ndarray:
    """Moves (from tag or start, to tag): an inside tag follows its own kind."""
    ok = np.ones((T + 1, T), bool)
    for j, tag in enumerate(TAGS):
        if tag[0] == "I":
            ok[:, j] = [x[2:] == tag[2:] and x != "O" for x in TAGS] + [False]
    return ok


def train(rows: list[tuple[str, list[tuple[str, int, int]]]], epochs: int = 60, rate: float = 0.2, decay: float = 1e-3) -> Crf:
    """Maximum likelihood by full-batch adaptive gradient over (text, spans) rows."""
    data = []
    names: dict[str, int] = {}
    for text, spans in rows:
        for chain in chains(text):
            feats = [[names.setdefault(f, len(names)) for f in row] for row in chain_features([text[s:e] for s, e in chain])]
            tags, last = [], None
            for s, e in chain:
                hit = next(((k, a, b) for k, a, b in spans if a < e and s < b), None)
                tags.append(TAGS.index("O" if hit is None else f"{'I' if hit == last else 'B'}-{hit[0]}"))
                last = hit
            data.append((np.array(feats), np.array(tags)))
    move = np.where(_allowed(), 0.0, -1e4)
    emit = np.zeros((len(names), T))
    if not data:
        return Crf(names, emit, move)
    width = len(data[0][0][0])
    n, longest = len(data), max(len(t) for _, t in data)
    x, y = np.zeros((n, longest, width), np.int64), np.zeros((n, longest), np.int64)
    mask = np.zeros((n, longest), bool)
    for i, (f, t) in enumerate(data):
        x[i, : len(t)], y[i, : len(t)], mask[i, : len(t)] = f, t, True
    gold = np.eye(T)[y] * mask[:, :, None]
    gold_move = np.zeros((T + 1, T))
    np.add.at(gold_move, (np.full(n, T), y[:, 0]), 1)
    for t in range(1, longest):
        np.add.at(gold_move, (y[mask[:, t], t - 1], y[mask[:, t], t]), 1)
    sq_e, sq_m = np.full_like(emit, 1e-6), np.full_like(move, 1e-6)
    for _ in range(epochs):
        s = emit[x].sum(axis=2)
        alpha, beta = np.zeros((n, longest, T)), np.zeros((n, longest, T))
        alpha[:, 0] = s[:, 0] + move[T]
        for t in range(1, longest):
            new = np.logaddexp.reduce(alpha[:, t - 1, :, None] + move[None, :T], axis=1) + s[:, t]
            alpha[:, t] = np.where(mask[:, t, None], new, alpha[:, t - 1])
        total = np.logaddexp.reduce(alpha[:, -1], axis=1)
        want_move = np.zeros((T + 1, T))
        for t in range(longest - 2, -1, -1):
            ahead = s[:, t + 1] + beta[:, t + 1]
            new = np.logaddexp.reduce(move[None, :T] + ahead[:, None, :], axis=2)
            beta[:, t] = np.where(mask[:, t + 1, None], new, 0.0)
            pair = np.exp(alpha[:, t, :, None] + move[None, :T] + ahead[:, None, :] - total[:, None, None])
            want_move[:T] += pair[mask[:, t + 1]].sum(axis=0)
        p = np.exp(alpha + beta - total[:, None, None]) * mask[:, :, None]
        want_move[T] = p[:, 0].sum(axis=0)
        diff = (gold - p).reshape(-1, T)
        grad = np.zeros_like(emit)
        for k in range(width):
            np.add.at(grad, x[:, :, k].ravel(), diff)
        grad = grad / n - decay * emit
        grad_m = np.where(_allowed(), (gold_move - want_move) / n - decay * move, 0.0)
        sq_e += grad**2
        sq_m += grad_m**2
        emit = emit + rate * grad / np.sqrt(sq_e)
        move = move + rate * grad_m / np.sqrt(sq_m)
    return Crf(names, emit, move)


def labelled_rows(copies: int = 12, seed: int = 11) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """The small labelled table: texts with marked spans of each kind in several formats, and numbers of other kinds.

    Numbers and words are drawn anew for each copy of each line, from a fixed seed.
    """
    rng = random.Random(seed)

    def digits(n: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(n))

    def word() -> str:
        return "".join(rng.choice("abcdefghijklmnoprstuvwzéñü") for _ in range(rng.randint(1, 9)))

    private = [
        ("email", lambda: f"{word()}.{digits(2)}@mail{digits(1)}.example.com".replace("é", "e").replace("ñ", "n").replace("ü", "u")),
        ("email", lambda: "jo" + digits(2) + "@host.org"),
        ("email", lambda: "Ana_B@mail.example.net"),
        ("email", lambda: "max+tag@sub.host.co"),
        ("ip", lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4))),
        ("ip", lambda: ".".join(str(rng.randint(10, 299)) for _ in range(4))),
        ("card", lambda: digits(16)),
        ("card", lambda: digits(rng.choice((13, 14, 15, 17, 18, 19)))),
        ("card", lambda: " ".join(digits(4) for _ in range(4))),
        ("card", lambda: "-".join(digits(4) for _ in range(4))),
        ("card", lambda: f"{digits(4)} {digits(6)} {digits(5)}"),
        ("phone", lambda: f"+1 ({digits(3)}) 555-{digits(4)}"),
        ("phone", lambda: f"({digits(3)}) 555-{digits(4)}"),
        ("phone", lambda: f"{digits(3)}-555-{digits(4)}"),
        ("phone", lambda: f"+{digits(2)} {digits(3)} {digits(7)}"),
        ("phone", lambda: f"+{digits(2)}{digits(9)}"),
        ("phone", lambda: f"+{digits(2)}-{digits(3)}-{digits(3)}-{digits(4)}"),
    ]
    other = [
        lambda: str(rng.randint(1900, 2030)),
        lambda: digits(1),
        lambda: digits(2),
        lambda: digits(3),
        lambda: digits(rng.randint(5, 8)),
        lambda: f"{rng.randint(1, 99)}.{digits(2)}",
        lambda: f"{rng.randint(1, 9)}.{digits(1)}.{digits(1)}",
        lambda: f"{digits(2)}:{digits(2)}",
        lambda: f"20{digits(2)}-{digits(2)}-{digits(2)}",
        lambda: f"{digits(2)}/{digits(2)}/20{digits(2)}",
        lambda: f"{rng.randint(1, 999)},{digits(3)}",
        lambda: f"${digits(2)}.{digits(2)}",
        lambda: f"{digits(2)}%",
        lambda: f"v{digits(1)}.{digits(1)}",
        lambda: f"[{digits(2)}]",
        lambda: f"{word()}{digits(2)}",
        lambda: f"{digits(1)}th",
        lambda: f"{digits(3)} {digits(3)}",
        lambda: f"{digits(2)} of {digits(3)}",
        lambda: "@" + word(),
        lambda: word() + " @ " + word(),
        lambda: 'token = "' + hashlib.sha1(digits(9).encode()).hexdigest() + '"',
        lambda: digits(24),
    ]
    rows: list[tuple[str, list[tuple[str, int, int]]]] = []
    for _ in range(copies):
        for kind, make in [*private, *[("", f) for f in other]]:
            before = word() + rng.choice(("", "", ".", ",", " |")) + " "
            body = make()
            after = rng.choice(("", "", ".", ",", "!!", " |", "***", "%%%")) + " " + word()
            text = before + body + after
            rows.append((text, [(kind, len(before), len(before) + len(body))] if kind else []))
    return rows


def labelled_table(spark: SparkSession) -> DataFrame:
    """``labelled_rows`` as a table (text, spans)."""
    return spark.createDataFrame(labelled_rows(), "text string, spans array<struct<kind:string,start:int,end:int>>")


def crf_spans(text: str, crf: Crf) -> list[tuple[str, int, int]]:
    """The spans that the CRF finds, as (kind, start, end), without punctuation at their ends."""
    found = chains(text)
    if not found:
        return []
    paths = crf.decode([crf.scores(chain_features([text[s:e] for s, e in c])) for c in found])
    return _spans_of(text, found, paths)


def _spans_of(text: str, found: list[list[tuple[int, int]]], paths: list[list[int]]) -> list[tuple[str, int, int]]:
    out = []
    for chain, path in zip(found, paths):
        open_: list | None = None
        for (s, e), tag in zip([*chain, (0, 0)], [*path, 0]):
            name = TAGS[tag]
            inside = name[0] == "I" and open_ and open_[0] == name[2:]
            full = inside and open_[0] == "card" and sum(c.isdigit() for c in text[open_[1] : e]) > CARD_DIGITS
            if inside and not full:
                open_[2] = e
                continue
            if open_:
                kind, a, b = open_
                while a < b and not (text[a].isalnum() or text[a] in "+("):
                    a += 1
                while a < b and not (text[b - 1].isalnum() or text[b - 1] == ")"):
                    b -= 1
                if "@" in text[a:b] if kind == "email" else sum(c.isdigit() for c in text[a:b]) >= 4:
                    out.append((kind, a, b))
            open_ = [name[2:], s, e] if name[0] == "B" or full else None
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def all_spans(base: list[tuple[str, int, int]], found: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Base spans and those of the CRF that overlap none of them, by kind as listed, then start."""
    taken = sorted((s, e) for _, s, e in base)
    starts = [s for s, _ in taken]
    import bisect

    def free(s: int, e: int) -> bool:
        i = bisect.bisect_left(starts, e)
        return not any(a < e and s < b for a, b in taken[max(0, i - 4) : i])

    more = [x for x in found if free(x[1], x[2])]
    return sorted([*base, *more], key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def find_private(docs: DataFrame, labelled: DataFrame, key: str = "doc_id", text: str = "text", max_rows: int = 20_000) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_crf, a row for each row of ``docs``.

    ``labelled`` is a table (text, spans) that the CRF is trained from on the
    driver, by at most ``max_rows`` of its rows, those with the smallest hash
    of text and spans.  The counts are those of the base spans; spans adds the
    CRF's, n_crf of them.  Null and empty texts have no spans; repeated rows
    come as often as they are; an empty table gives none; without labelled
    rows there are base spans alone.  Nothing is cut: very long texts are
    searched whole.  Other columns are not read.
    """
    order = F.xxhash64("text", F.to_json("spans"))
    rows = labelled.select("text", "spans", order.alias("h")).orderBy("h", "text").limit(max_rows).collect()
    crf = train([(r["text"] or "", [tuple(x) for x in r["spans"] or []]) for r in rows])
    shared = docs.sparkSession.sparkContext.broadcast(crf)  # a few thousand features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(1).to_pylist()
                base = [base_spans(t) for t in texts]
                chained = [chains(t) for t in texts]
                scores = [own.scores(chain_features([t[s:e] for s, e in c])) for t, cs in zip(texts, chained) for c in cs]
                paths = iter(own.decode(scores))
                found = [_spans_of(t, cs, [next(paths) for _ in cs]) for t, cs in zip(texts, chained)]
                both = [all_spans(b, f) for b, f in zip(base, found)]
                counts: dict[str, list[int]] = defaultdict(list)
                for b in base:
                    for k in KINDS:
                        counts[k].append(sum(x[0] == k for x in b))
                columns = [part.column(0), *[pa.array(counts[k], pa.int64()) for k in KINDS]]
                columns += [pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base]), pa.array([joined(x) for x in both]), pa.array([len(x) - len(b) for x, b in zip(both, base)], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_crf"])

    slim = docs.select(F.col(key).alias("doc_id"), text_of(text).alias("text"))
    schema = f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_crf long"
    return slim.mapInArrow(run, schema)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_private(table(spark, sf_dir, "documents"), labelled_table(spark))
