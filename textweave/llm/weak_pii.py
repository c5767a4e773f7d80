"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides.

Base spans of four kinds come from fixed patterns and always stay. Looser candidates (numbers with
other separators, mail addresses spelt out) and the base spans are voted on by six labelers: two
read the form, one a gazetteer, one the context, one the neighbouring characters, one the grouping.
A vote is 1, 0 (abstains) or -1. Counts of equal votes over the whole corpus, at most ``3 ** 6`` a
kind, go to the driver, where expectation maximisation (Dawid and Skene, 1979) finds how far each
labeler can be trusted. The posteriors of a bounded sample of candidates train a logistic
regression over hashed span features, and the candidates it accepts are added to the base spans.

The texts are read twice, without a shuffle of texts: once for the votes, once for the spans.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textweave.llm.words import pieces, unused
from textweave.session import materialise

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("form", "check", "gazetteer", "context", "neighbours", "grouping")
PLACES = 1 << 12

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_PART = re.compile(r"[0-9]+")
_NOT_DIGIT = re.compile(r"[^0-9]+")

_CHAIN = re.compile(r"\+?\(?[0-9](?:[().,:/_\x20‐-―-]{0,3}+[0-9])*")
_SPELT = re.compile(r"(?:[\[({][\x20]?(?:at|AT)[\x20]?[\])}])|(?:\x20(?:at|AT)\x20)")
_SPELT_END = re.compile(r"[\x20]?([A-Za-z0-9-]{1,63}(?:(?:[\x20]?[\[({][\x20]?(?:dot|DOT)[\x20]?[\])}][\x20]?|\x20(?:dot|DOT)\x20)[A-Za-z0-9-]{1,63}){1,5})")
_NAME_BEFORE = re.compile(r"[A-Za-z0-9._%+-]{1,64}[\x20]?\Z")

# Gazetteers: prefixes of card issuers, calling codes, top-level domains.
ISSUERS = ("34", "35", "36", "37", "38", "4", "51", "52", "53", "54", "55", "60", "62", "64", "65")
CALLING = ("1", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49",
           "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "7", "81", "82", "84", "86", "90", "91")
DOMAINS = frozenset(("com", "net", "org", "edu", "gov", "info", "biz", "io", "de", "fr", "es", "uk", "it", "nl", "eu", "us", "ch", "at"))
# Words that speak for a kind when they stand before a span, and words that speak against all.
SPEAKING = {
    "email": frozenset(("mail", "email", "e-mail", "contact", "write", "correo", "courriel", "kontakt")),
    "ip": frozenset(("ip", "host", "server", "address", "client", "from", "dirección", "adresse")),
    "card": frozenset(("card", "visa", "mastercard", "amex", "credit", "payment", "tarjeta", "carte", "karte")),
    "phone": frozenset(("phone", "tel", "telephone", "call", "fax", "mobile", "cell", "teléfono", "téléphone", "telefon")),
}
AGAINST = frozenset(("version", "isbn", "issn", "order", "page", "no", "id", "token", "password", "serial", "key", "doi", "section", "total"))
_WORD = re.compile(r"[^\W\d_][\w-]*")


@dataclass(frozen=True)
class Settings:
    """``sample_rows`` bounds the candidates that the classifier is fitted on: those with the smallest hash."""

    sample_rows: int = 20_000
    rounds: int = 60
    epochs: int = 300
    accepted_from: float = 0.5


def luhn(digits: str) -> bool:
    total = 0
    for place, c in enumerate(reversed(digits)):
        value = ord(c) - 48
        total += value if place % 2 == 0 else value * 2 - 9 * (value > 4)
    return total % 10 == 0


def small_parts(parts: list[str]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the mail pattern. Only the characters around each ``@`` are looked at."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(done, at + 1))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four dotted numbers each; a longer chain gives several from its left end."""
    for chain in _DOTTED.finditer(text):
        if chain.group().count(".") < 3:
            continue
        parts = list(_PART.finditer(text, chain.start(), chain.end()))
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            if small_parts([p.group() for p in four]):
                yield four[0].start(), four[3].end()


def cards(text: str) -> Iterator[tuple[int, int]]:
    for found in _CARD.finditer(text):
        if found.end() - found.start() >= 12:
            digits = _NOT_DIGIT.sub("", found.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield found.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for found in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", found.group())) <= 15:
                yield found.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the base patterns, in order; the kind by number."""
    found = [(s, k, e) for k, matches in enumerate((emails, addresses, cards, phones)) for s, e in matches(text)]
    return sorted(found)


def loose_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates beside the base spans, none of which they overlap; one span may have two kinds."""
    found: list[tuple[int, int, int]] = []
    for chain in _CHAIN.finditer(text):
        start, end = chain.span()
        if end - start < 7:
            continue
        digits = _NOT_DIGIT.sub("", chain.group())
        if 7 <= len(digits) <= 15:
            found.append((start, 3, end))
        if 12 <= len(digits) <= 19:
            found.append((start, 2, end))
        if len(digits) <= 12 and len(_PART.findall(chain.group())) == 4:
            found.append((start, 1, end))
    for sign in _SPELT.finditer(text):
        after = _SPELT_END.match(text, sign.end())
        before = after and _NAME_BEFORE.search(text[max(0, sign.start() - 65) : sign.start()])
        if before:
            found.append((sign.start() - len(before.group()), 0, after.end()))
    if base and found:
        starts = np.array([s for s, _, _ in base])
        furthest = np.maximum.accumulate([e for _, _, e in base])
        before = np.searchsorted(starts, [e for _, _, e in found]) - 1  # the last base span that starts before the end
        found = [c for c, i in zip(found, before.tolist(), strict=True) if i < 0 or furthest[i] <= c[0]]
    return sorted(found)


def _words_before(text: str, start: int) -> list[str]:
    return [w.lower() for w in _WORD.findall(text[max(0, start - 48) : start])][-4:]


def checks(kind: int, span: str, digits: str) -> bool:
    if kind == 0:
        return not any(part.startswith("-") or part.endswith("-") for part in re.split(r"[@.\x20]", span) if part)
    if kind == 1:
        return small_parts(_PART.findall(span))
    return luhn(digits) and 12 <= len(digits) <= 19 if kind == 2 else 9 <= len(digits) <= 15


def votes(kind: int, text: str, start: int, end: int, is_base: bool) -> tuple[int, ...]:
    """The votes of all labelers on one candidate."""
    span = text[start:end]
    digits = _NOT_DIGIT.sub("", span)
    sound = 1 if checks(kind, span, digits) else -1
    before, after = text[start - 1 : start], text[end : end + 1]
    near = _words_before(text, start)
    context = 1 if SPEAKING[KINDS[kind]].intersection(near) else -1 if AGAINST.intersection(near) else 0
    cut = any(c and (c.isalnum() or c in "=#_/\\\"'") for c in (before, after))
    groups = [len(p) for p in _PART.findall(span)]
    if kind == 0:
        known = 1 if span.rpartition(".")[2].rpartition(" ")[2].lower() in DOMAINS else 0
        grouping = 1 if "@" in span or "(" in span or "[" in span else -1
    elif kind == 1:
        first = int(digits[: groups[0]] or 0) if groups[0] <= 3 else 999
        known = 1 if 0 < first < 224 and first != 127 else -1
        grouping = 1 if _PART.sub("", span) == "..." else -1
    elif kind == 2:
        known = 1 if digits.startswith(ISSUERS) else -1
        grouping = 1 if len(groups) == 1 or (len(groups) > 2 and max(groups[:-1]) - min(groups[:-1]) <= 2 and max(groups) <= 6) else -1
    else:
        abroad = digits[2:] if digits.startswith("00") else digits if span.startswith("+") else ""
        known = 1 if abroad.startswith(CALLING) else 0 if "(" in span else -1
        dotted = _PART.sub("", span) == "..."  # as versions and addresses are written
        grouping = 1 if len(groups) in (3, 4, 5) and max(groups) <= 4 and groups[-1] >= 2 and not dotted else -1
    return (1 if is_base else 0 if sound > 0 else -1, sound, known, context, -1 if cut else 1, grouping)


def features(kind: int, text: str, start: int, end: int) -> list[int]:
    """Hashed features of one candidate: shape, separators, length, check, words and signs around it."""
    span = text[start:end]
    digits = _NOT_DIGIT.sub("", span)
    shape = re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", lambda m: str(min(len(m.group()), 9)), span))[:48]
    near = _words_before(text, start)
    before, after = text[start - 1 : start], text[end : end + 1]
    sort = lambda c: "edge" if not c else "blank" if c.isspace() else "word" if c.isalnum() else c
    named = [
        "bias", f"shape {shape}", f"digits {len(digits)}", f"check {checks(kind, span, digits)}",
        f"signs {''.join(sorted(set(re.sub(r'[0-9A-Za-z]+', '', span))))}", f"left {sort(before)}", f"right {sort(after)}",
        f"speaks {bool(SPEAKING[KINDS[kind]].intersection(near))}", f"against {bool(AGAINST.intersection(near))}",
        f"first {digits[:1]}", *(f"word {w}" for w in near[-2:]),
    ]
    return [zlib.crc32(f"{kind} {name}".encode()) % PLACES for name in named]


def candidates(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``(kind, pattern, place, features)`` of every candidate; ``pattern`` is the votes in base three."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                rows = []
                for key, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    base = base_spans(text or "")
                    for spans, is_base in ((base, True), (loose_spans(text or "", base), False)):
                        for start, kind, end in spans:
                            pattern = 0
                            for vote in votes(kind, text, start, end, is_base):
                                pattern = pattern * 3 + vote + 1
                            place = xxhash.xxh64_intdigest(f"{key} {start} {kind} {text[start:end]}") >> 1
                            rows.append((kind, pattern, place, features(kind, text, start, end)))
                columns = [list(c) for c in zip(*rows, strict=True)] or [[], [], [], []]
                kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["kind", "pattern", "place", "features"])

    given = docs.select(F.col(id_column).cast("string").alias("id"), F.col(text_column).alias("text"))
    return given.mapInArrow(found, "kind int, pattern int, place bigint, features array<int>")


def unpacked(patterns: np.ndarray) -> np.ndarray:
    """Votes, one row for each pattern."""
    powers = 3 ** np.arange(len(LABELERS) - 1, -1, -1)
    return patterns[:, None] // powers % 3 - 1


def reliabilities(given: np.ndarray, counts: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """EM over vote patterns: the posterior of each pattern, and ``P(vote | class)`` by labeler, class and vote.

    Starts from the majority; prior counts keep a labeler more often right than wrong, and every
    probability above zero.
    """
    prior = np.ones((len(LABELERS), 2, 3))
    prior[:, 0, 0] = prior[:, 1, 2] = 4
    posterior = 1 / (1 + np.exp(-given.sum(axis=1)))
    shown = np.stack([given == v for v in (-1, 0, 1)], axis=2).astype(np.float64)
    for _ in range(rounds):
        weight = np.stack([counts * (1 - posterior), counts * posterior])
        table = np.einsum("yp,plv->lyv", weight, shown) + prior
        table /= table.sum(axis=2, keepdims=True)
        share = (weight.sum(axis=1) + 1) / (counts.sum() + 2)
        logs = np.einsum("plv,lyv->py", shown, np.log(table)) + np.log(share)
        posterior = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))
    return posterior, table


def regression(rows: list[list[int]], targets: np.ndarray, epochs: int) -> np.ndarray:
    """Weights of a logistic regression on soft targets, by full gradient steps with rates by coordinate."""
    w, squares = np.zeros(PLACES), np.full(PLACES, 1e-6)
    if not rows:
        return w
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    flat, owner = np.concatenate([np.asarray(r, np.int64) for r in rows]), np.repeat(np.arange(len(rows)), sizes)
    for _ in range(epochs):
        logits = np.bincount(owner, weights=w[flat], minlength=len(rows))
        gap = 1 / (1 + np.exp(-np.clip(logits, -35, 35))) - targets
        gradient = np.bincount(flat, weights=gap[owner], minlength=PLACES) / len(rows) + 1e-5 * w
        squares += gradient * gradient
        w -= 0.3 * gradient / np.sqrt(squares)
    return w


@dataclass
class Model:
    """``weights`` of the span classifier; ``trust`` holds ``P(vote | class)`` by kind."""

    weights: np.ndarray
    trust: dict[str, np.ndarray]


def fit(docs: DataFrame, settings: Settings = Settings(), id_column: str = "doc_id", text_column: str = "text") -> Model:
    """Reliabilities from the votes on all candidates of ``docs``, and the span classifier."""
    found = materialise(candidates(docs, id_column, text_column), "pii-candidates")
    # At most 3 ** 6 patterns of each kind.
    patterns = found.groupBy("kind", "pattern").count().orderBy("kind", "pattern").toPandas()
    posterior, trust = {}, {}
    for kind, part in patterns.groupby("kind"):
        given = unpacked(part["pattern"].to_numpy())
        each, trust[KINDS[kind]] = reliabilities(given, part["count"].to_numpy(np.float64), settings.rounds)
        posterior |= {(kind, p): q for p, q in zip(part["pattern"], each, strict=True)}
    sample = found.orderBy("place", "kind", "pattern", "features").limit(settings.sample_rows).collect()
    targets = np.array([posterior[r["kind"], r["pattern"]] for r in sample])
    return Model(regression([r["features"] for r in sample], targets, settings.epochs), trust)


def spans_of(text: str, weights: np.ndarray, accepted_from: float) -> tuple[list, list]:
    """Base spans, and the accepted candidates; of candidates that overlap the likeliest stays, ties to the first."""
    base = base_spans(text)
    scored = []
    for start, kind, end in loose_spans(text, base):
        logit = weights[features(kind, text, start, end)].sum()
        if 1 / (1 + np.exp(-np.clip(logit, -35, 35))) >= accepted_from:
            scored.append((-logit, start, kind, end))
    added: list[tuple[int, int, int]] = []
    taken = np.zeros(len(text), bool) if scored else None
    for _, start, kind, end in sorted(scored):
        if not taken[start:end].any():
            taken[start:end] = True
            added.append((start, kind, end))
    return base, added


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def personal_data(
    docs: DataFrame, settings: Settings = Settings(), id_column: str = "doc_id", text_column: str = "text", model: Model | None = None
) -> DataFrame:
    """One row for each row of ``docs``: ``id_column, n_email, n_ip, n_card, n_phone, n_added, base_spans, spans``.

    Counts and ``base_spans`` are of the base patterns; ``spans`` has the added ones too. Both are
    ``kind:start:end`` in code points, by start, then kind. Null and empty texts have no spans. Rows
    given twice come twice, with the same spans. Without candidates nothing is added. An empty table
    gives an empty result; other columns are not read.
    """
    model = model or fit(docs, settings, id_column, text_column)
    weights = model.weights
    key = unused(docs.select(text_column), "id")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                every = [spans_of(text or "", weights, settings.accepted_from) for text in piece.column(1).to_pylist()]
                counts = [[sum(k == kind for _, k, _ in base) for base, _ in every] for kind in range(len(KINDS))]
                columns = [piece.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array([len(a) for _, a in every], pa.int64())]
                columns += [pa.array([written(b) for b, _ in every], pa.string()), pa.array([written(b + a) for b, a in every], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [key, *names])

    names = [*(f"n_{kind}" for kind in KINDS), "n_added", "base_spans", "spans"]
    kinds = [*("bigint" for _ in KINDS), "bigint", "string", "string"]
    given = docs.select(F.col(id_column).alias(key), F.col(text_column).alias("text"))
    schema = ", ".join([f"`{key}` {dict(docs.dtypes)[id_column]}", *(f"{n} {k}" for n, k in zip(names, kinds, strict=True))])
    return given.mapInArrow(found, schema).withColumnRenamed(key, id_column)
