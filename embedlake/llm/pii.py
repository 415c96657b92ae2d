"""Personal data: fixed patterns, and a linear-chain conditional random field.

The field labels words (runs of non-blank characters) as O or as the beginning
or inside of an entity, from word shapes of a word and its two neighbours. It
is trained on a small labelled table and decoded by Viterbi. Words with a digit
or an @, cue words, and all words up to REACH words from one of them form runs;
the rest is O. A run goes over a single line break and ends at a blank line. All
runs of a slice of texts are decoded together, one position at a time.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from embedlake.llm import batches
from embedlake.llm.words import Texts, Words, not_blank

# Fixed values of the base rules; the look-behinds only save repeated work.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
MAILBOX = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
BASE = ["email", "ip", "card", "phone"]

# What the field finds beside the base: spelled-out mail addresses, national
# telephone numbers, personal identity numbers and bank accounts.
ENTITIES = ["email", "phone", "identity", "account"]
LABELS = ["O", *[f"{part}-{kind}" for kind in ENTITIES for part in "BI"]]
FIELD_KINDS = [f"field_{kind}" for kind in ENTITIES]

# Words the features know by name.
CUES = (
    "at dot mail email e-mail contact write reach com org net edu "
    "tel tel. phone phone: call fax mobile ssn ssn: social security number id "
    "iban iban: account bank no no. ext"
).split()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The matches of EMAIL, left to right, found from their signs.

    A search from the left tries every place of a long run that no sign ends;
    here each run before a sign is walked once, from the sign to the left, and
    never into the match before it.
    """
    end, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > end and text[begin - 1] in MAILBOX:
            begin -= 1
        # A run cut by a sign can't hold another one, so what follows decides.
        found = DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            end = found.end()
            yield begin, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base matches that pass."""
    found = []
    found += [(0, *span) for span in _emails(text)]
    for m in IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            found.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((3, m.start(), m.end()))
    return found


# ---- word shapes ---------------------------------------------------------

SIZES = [8 * 2 * 2, 6 * 7, 4 * 2 * 2 * 2 * 2, 7, len(CUES) + 1]


@cache
def _cue_hashes() -> tuple[np.ndarray, np.ndarray]:
    hashes = Words(Texts([" ".join(CUES)]), not_blank(), lower=True).hashes
    order = np.argsort(hashes)
    return hashes[order], order + 1


def _byte_class() -> np.ndarray:
    kind = np.full(256, 6, "i8")
    kind[ord("a") : ord("z") + 1] = 0
    kind[0x80:] = 0
    kind[ord("A") : ord("Z") + 1] = 1
    kind[ord("0") : ord("9") + 1] = 2
    kind[ord("+")] = 3
    kind[[ord("("), ord(")")]] = 4
    kind[[ord("."), ord(","), ord(";"), ord(":")]] = 5
    return kind


def shapes(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Feature codes (words, 5) and the flags of words that are always O."""
    data = words.texts.data

    def count(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype="i4")])
        return total[words.ends] - total[words.starts]

    kinds = _byte_class()
    per_byte = kinds[data]
    digits, letters = count(per_byte == 2), count(per_byte <= 1)
    dots, ats = count(data == ord(".")), count(data == ord("@"))
    dashes, plus, brackets = count(data == ord("-")), count(data == ord("+")), count(per_byte == 4)
    length = words.ends - words.starts
    bucket = np.searchsorted([1, 2, 3, 4, 5, 9, 13], digits, "right")
    size = np.searchsorted([2, 4, 9, 17, 33], length, "right")
    first = per_byte[words.starts] if len(length) else np.empty(0, "i8")
    last = per_byte[words.ends - 1] if len(length) else np.empty(0, "i8")
    hashes, places = _cue_hashes()
    at = np.minimum(np.searchsorted(hashes, words.hashes), len(hashes) - 1)
    cue = np.where(hashes[at] == words.hashes, places[at], 0)
    codes = np.stack(
        [
            (bucket * 2 + (digits + letters == length)) * 2 + (letters > 0),
            size * 7 + first,
            (((np.minimum(dots, 3) * 2 + (ats > 0)) * 2 + (dashes > 0)) * 2 + (plus > 0)) * 2 + (brackets > 0),
            last,
            cue,
        ],
        1,
    )
    return codes, (digits == 0) & (ats == 0) & (cue == 0)


# ---- the labelled table --------------------------------------------------


def labelled(sentences: int = 500, seed: int = 11) -> list[tuple[list[str], list[str]]]:
    """(words, labels) rows, drawn from templates: entities and their look-alikes."""
    draw = random.Random(seed)
    digits = lambda n: "".join(draw.choices("0123456789", k=n))
    letters = lambda a, b: "".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randint(a, b)))

    def mark(words: list[str], kind: str) -> list[tuple[str, str]]:
        return [(w, f"{'B' if i == 0 else 'I'}-{kind}") for i, w in enumerate(words)]

    def email():
        domain = draw.choice([[letters(4, 8), "dot", draw.choice(["com", "org", "net", "edu"])]])
        name = [letters(3, 8)] if draw.random() < 0.5 else [letters(3, 8), "dot", letters(3, 8)]
        return mark([*name, "at", *domain], "email")

    def phone():
        return mark(
            draw.choice(
                [
                    [f"({digits(3)})", f"{digits(3)}-{digits(4)}"],
                    [f"{digits(3)}-{digits(3)}-{digits(4)}"],
                    [f"{digits(3)}.{digits(3)}.{digits(4)}"],
                    [f"0{digits(3)}", digits(3), digits(4)],
                    [f"({digits(3)})", digits(3), digits(4)],
                ]
            ),
            "phone",
        )

    def identity():
        return mark([f"{digits(3)}-{digits(2)}-{digits(4)}"], "identity")

    def account():
        head = "".join(draw.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ", k=2)) + digits(2)
        groups = [digits(4) for _ in range(draw.randint(3, 5))] + [digits(2)] * draw.randint(0, 1)
        if draw.random() < 0.4:
            groups[0] = letters(4, 4).upper()
        return mark([head + "".join(groups)] if draw.random() < 0.5 else [head, *groups], "account")

    def other():
        return [
            (w, "O")
            for w in draw.choice(
                [
                    [digits(draw.randint(1, 16))],
                    [f"{draw.randint(1900, 2030)}-{digits(2)}-{digits(2)}"],
                    [f"{digits(2)}.{digits(2)}.{digits(4)}"],
                    [".".join(digits(draw.randint(1, 3)) for _ in range(4))],
                    [f"{letters(3, 8)}@{letters(3, 8)}.com"],
                    ["".join(draw.choices("0123456789abcdef", k=draw.choice([8, 16, 40])))],
                    [f"+{draw.randint(1, 99)}", f"({digits(3)})", f"{digits(3)}-{digits(4)}"],
                    [f"{draw.randint(1, 999)}.{digits(2)}"],
                    ["at", letters(3, 8)],
                    ["at", digits(2)],
                    [draw.choice(["number", "id", "no.", "account", "call", "mail"]), letters(3, 9)],
                    [f"v{draw.randint(1, 9)}.{draw.randint(0, 20)}"],
                    [letters(2, 5).upper() + digits(3)],
                    [digits(4), digits(4), digits(4), digits(4)],
                ]
            )
        ]

    cues = {"email": ["mail", "contact", "write", "reach"], "phone": ["call", "tel", "phone"]}
    cues |= {"identity": ["ssn", "id", "number"], "account": ["iban", "account"]}
    rows = []
    for _ in range(sentences):
        row = [(letters(1, 9), "O") for _ in range(draw.randint(1, 4))]
        for _ in range(draw.randint(1, 2)):
            make = draw.choice([email, phone, identity, account, other, other, other])
            if make is not other and draw.random() < 0.4:
                row.append((draw.choice(cues[make.__name__]), "O"))
            part = make()
            if draw.random() < 0.3:
                part[-1] = (part[-1][0] + draw.choice(".,"), part[-1][1])
            row += part + [(letters(1, 9), "O") for _ in range(draw.randint(1, 4))]
        rows.append(([w for w, _ in row], [x for _, x in row]))
    return rows


# ---- the field -----------------------------------------------------------


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


@dataclass
class Field:
    """Weights: for offset -1, 0, 1 and feature f a table (code, label); moves (label, label)."""

    tables: list[list[np.ndarray]]
    moves: np.ndarray

    def emissions(self, codes: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Scores (words, labels); before, after: row of the neighbour or -1."""
        every, place = np.unique(codes, axis=0, return_inverse=True)
        place = place.reshape(-1)
        parts = [sum(table[every[:, f]] for f, table in enumerate(tables)) for tables in self.tables]
        out = parts[1][place].copy()
        for part, near in ((parts[0], before), (parts[2], after)):
            have = near >= 0
            out[have] += part[place[near[have]]]
        return out

    def viterbi(self, scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best labels of the words of all runs; longest runs first inside."""
        labels = np.zeros(len(scores), "i1")
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        if not len(lengths):
            return labels
        best, back = scores[starts] + self.moves[0], []
        for t in range(1, int(lengths[0])):
            live = int(np.searchsorted(-lengths, -t, "left"))
            total = best[:live, :, None] + self.moves
            back.append(total.argmax(1).astype("i1"))
            step = best.copy()
            step[:live] = total.max(1) + scores[starts[:live] + t]
            best = step
        at = (best + self.moves[:, 0]).argmax(1)
        for t in range(int(lengths[0]) - 1, -1, -1):
            live = int(np.searchsorted(-lengths, -t, "left"))
            labels[starts[:live] + t] = at[:live]
            if t:
                rows = np.arange(live)
                at[:live] = back[t - 1][rows, at[:live]]
        return labels


def train(rows: list[tuple[list[str], list[str]]], rounds: int = 80, rate: float = 0.3, decay: float = 1e-3) -> Field:
    """Maximise the conditional likelihood by adaptive gradient steps.

    Rows without words are skipped. A chain begins and ends in O.
    """
    rows = [r for r in rows if r[0]]
    n, size = len(rows), len(LABELS)
    lengths = np.array([len(w) for w, _ in rows])
    codes, _ = shapes(Words(Texts([" ".join(w) for w, _ in rows]), not_blank(), lower=True))
    truth = np.array([LABELS.index(x) for _, labels in rows for x in labels])
    first = np.cumsum(lengths) - lengths
    row_of = np.repeat(np.arange(n), lengths)
    at = np.arange(len(codes))
    before = np.where(at > first[row_of], at - 1, -1)
    after = np.where(at < (first + lengths - 1)[row_of], at + 1, -1)
    field = Field([[np.zeros((s, size)) for s in SIZES] for _ in range(3)], np.zeros((size, size)))
    # I-x follows only B-x or I-x.
    barred = np.array([[b[0] == "I" and a[2:] != b[2:] for b in LABELS] for a in LABELS])
    field.moves[barred] = -50.0
    squares = [[np.full_like(t, 1e-6) for t in ts] for ts in field.tables]
    squares_moves = np.full_like(field.moves, 1e-6)
    longest = int(lengths.max())
    grid = np.minimum(first[:, None] + np.arange(longest), len(codes) - 1)
    live = np.arange(longest) < lengths[:, None]
    hot = np.zeros((len(codes), size))
    hot[at, truth] = 1
    seen_moves = np.zeros((size, size))
    ends = np.zeros(len(codes), bool)
    ends[first + lengths - 1] = True
    np.add.at(seen_moves, (np.where(before >= 0, truth[before], 0), truth), 1)
    np.add.at(seen_moves, (truth[ends], 0), 1)
    for _ in range(rounds):
        scores = field.emissions(codes, before, after)[grid]
        forward = np.empty_like(scores)
        forward[:, 0] = scores[:, 0] + field.moves[0]
        for t in range(1, longest):
            step = _lse(forward[:, t - 1, :, None] + field.moves, 1) + scores[:, t]
            forward[:, t] = np.where(live[:, t, None], step, forward[:, t - 1])
        backward = np.empty_like(scores)
        backward[:, -1] = field.moves[:, 0]
        for t in range(longest - 2, -1, -1):
            step = _lse(field.moves + (scores[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(live[:, t + 1, None], step, field.moves[:, 0])
        norm = _lse(forward[:, -1] + field.moves[:, 0], 1)
        chance = np.exp(forward + backward - norm[:, None, None])
        gap = hot - chance[live]
        moved = np.zeros((size, size))
        for t in range(1, longest):
            both = forward[:, t - 1, :, None] + field.moves + (scores[:, t] + backward[:, t])[:, None, :]
            moved += (np.exp(both - norm[:, None, None]) * live[:, t, None, None]).sum(0)
        moved[0] += chance[:, 0].sum(0)
        moved[:, 0] += chance[np.arange(n), lengths - 1].sum(0)
        for k, near in enumerate((before, at, after)):
            have = near >= 0
            for f, table in enumerate(field.tables[k]):
                slope = np.zeros_like(table)
                np.add.at(slope, codes[near[have], f], gap[have])
                slope = slope / n - decay * table
                squares[k][f] += slope**2
                table += rate * slope / np.sqrt(squares[k][f])
        slope = (seen_moves - moved) / n - decay * field.moves
        slope[barred] = 0
        squares_moves += slope**2
        field.moves += rate * slope / np.sqrt(squares_moves)
    return field


@cache
def default_field() -> Field:
    return train(labelled())


TRIM = ".,;:!?\"'"
# Plain words kept on each side of a word with a digit, an @ or a cue.
REACH = 3


def _passes(kind: str, words: str) -> bool:
    """Exact checks that follow the field."""
    digits = re.sub(r"[^0-9]", "", words)
    if kind == "email":
        return bool(re.search(r"\S(\sat\s|@)\S+\s?(\.|dot\s)\s?\S", words))
    if kind == "phone":
        return 9 <= len(digits) <= 12 and not re.search(r"[A-Za-z]", words)
    if kind == "identity":
        return len(digits) == 9 and words.count("-") == 2
    plain = re.sub(r"[^0-9A-Z]", "", words)
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[0-9A-Z]{11,30}", plain):
        return False
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def decode(texts: list[str] | list[bytes], field: Field) -> list[list[tuple[str, int, int]]]:
    """(kind, start, end) in code points, found by the field in each text."""
    held = Texts(texts)
    words = Words(held, not_blank(), lower=True)
    codes, inert = shapes(words)
    n = len(codes)
    found: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    if inert.all():
        return found
    # Plain words stand inside an entity (names, letter groups) or beside it.
    near = ~inert
    for step in range(1, REACH + 1):
        near[:-step] |= ~inert[step:]
        near[step:] |= ~inert[:-step]
    breaks = np.cumsum(held.data == 0x0A)[words.starts]
    home = np.searchsorted(words.first, np.arange(n), "right")
    new = np.ones(n, bool)
    new[1:] = (breaks[1:] > breaks[:-1] + 1) | (home[1:] != home[:-1])
    keep = np.flatnonzero(near)
    begins = np.ones(len(keep), bool)
    begins[1:] = (np.diff(keep) > 1) | new[keep[1:]]
    before = np.where(new[keep], -1, keep - 1)
    ends_run = np.append(new[1:], True)
    after = np.where(ends_run[keep], -1, keep + 1)
    used = np.unique(np.concatenate([keep, before[before >= 0], after[after >= 0]]))
    # Only the words of runs and their neighbours are scored.
    place = np.full(n, -1)
    place[used] = np.arange(len(used))
    near_before = np.full(len(used), -1)
    near_after = np.full(len(used), -1)
    near_before[place[keep]] = np.where(before >= 0, place[before], -1)
    near_after[place[keep]] = np.where(after >= 0, place[after], -1)
    scores = field.emissions(codes[used], near_before, near_after)[place[keep]]
    starts = np.flatnonzero(begins)
    labels = field.viterbi(scores, starts, np.diff(np.append(starts, len(keep))))
    hits = np.flatnonzero(labels > 0)
    if not len(hits):
        return found
    point = np.concatenate([[0], np.cumsum((held.data & 0xC0) != 0x80)])
    text_of = np.searchsorted(words.first, keep, "right") - 1
    i = 0
    while i < len(hits):
        j = i + 1
        while j < len(hits) and hits[j] == hits[j - 1] + 1 and labels[hits[j]] % 2 == 0 and not begins[hits[j]]:
            j += 1
        a, b = keep[hits[i]], keep[hits[j - 1]]
        raw = held.data[words.starts[a] : words.ends[b]].tobytes().decode("utf-8", "replace")
        kind, doc = ENTITIES[(int(labels[hits[i]]) - 1) // 2], int(text_of[hits[i]])
        body = raw.lstrip(TRIM)
        start = int(point[words.starts[a]] - point[held.begins[doc]]) + len(raw) - len(body)
        body = body.rstrip(TRIM)
        if _passes(kind, body):
            found[doc].append((f"field_{kind}", start, start + len(body)))
        i = j
    return found


def scan(docs: DataFrame, field: Field | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id, spans: array<struct<kind, start, end>>`, one row per input row.

    Spans are in code points, ends exclusive. Base spans (email, ip, card,
    phone) stay as they are; `field_...` spans come from the random field and
    never overlap them. A null or empty text has none. Null and repeated ids
    are kept. Row by row, no shuffle; the weights are a few hundred kilobytes.
    """
    weights = field or default_field()

    def run(parts):
        for part in batches.slices(parts):
            texts = batches.texts(part)
            rows = []
            for words, more in zip(texts, decode(texts, weights)):
                base = [(BASE[k], s, e) for k, s, e in base_spans(words)]
                free = [x for x in more if not any(s < x[2] and x[1] < e for _, s, e in base)]
                rows.append([{"kind": k, "start": s, "end": e} for k, s, e in base + free])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, kind)], ["doc_id", "spans"])

    id_kind = dict(docs.dtypes)[doc_id]
    schema = f"doc_id {id_kind}, spans array<struct<kind:string,start:bigint,end:bigint>>"
    return batches.take(docs, doc_id=doc_id, text=text).mapInArrow(run, schema)
