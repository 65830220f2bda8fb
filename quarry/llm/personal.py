"""Personal data: rules that always hold, and spans that weak labelers teach to find.

Labelers of three sorts (rules of form, lists of known values, words nearby) vote on every
candidate span. Expectation-maximisation over the counts of all vote patterns tells how
reliable each labeler is and how likely a pattern means personal data; a classifier of span
features learns these likelihoods and decides on the spans that the rules leave out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import small_batches, staged

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
LABELERS = ("form", "rule", "list", "word", "counter", "edge")
#: Votes of a span: one digit of base 3 per labeler (0 against, 1 no vote, 2 for).
PATTERNS = 3 ** len(LABELERS)

# Rules of the base spans. They match what the plain patterns match, in time linear in the text.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_HOST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_QUAD = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9]){12,}+")
_PLUS = re.compile(r"\+[0-9][ ().0-9-]++")

# Looser forms, candidates only.
_NUMBER = re.compile(r"(?<![0-9A-Za-z_])\(?[0-9](?:[ ().\-/   ]{0,2}[0-9]){6,}+")
_SPELT = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\s?[\[({<]\s?(?:at|@|arroba|chez)\s?[\])}>]\s?[A-Za-z0-9-]{1,63}(?:\s?[\[({<]\s?(?:dot|punkt|point|punto|\.)\s?[\])}>]\s?[A-Za-z0-9-]{2,63}|\.[A-Za-z0-9-]{2,63}){1,4}+", re.I)
_SIX = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4}){1,7}(?![0-9A-Za-z:])")
_BRACKETED = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3}(?![0-9.])")
_DATE = re.compile(r"(?:19|20)[0-9]{2}([-./ ])[01]?[0-9]\1[0-3]?[0-9]|[0-3]?[0-9]([-./ ])[01]?[0-9]\2(?:19|20)[0-9]{2}")

#: Words near a span that speak for its kind, in the order of KINDS.
CUES = tuple(
    re.compile(r"\b(?:" + words + r")\b", re.I)
    for words in (
        r"e-?mail|mail|contact|kontakt|write to|reach me|schreib\w*|courriel|écri\w+|correo|escrib\w+",
        r"ip|ipv[46]|address|adresse|dirección|host|server|serveur|servidor|client|login|logged in",
        r"card|visa|mastercard|amex|credit|debit|karte|kreditkarte|carte|bancaire|tarjeta|pan",
        r"phone|tel|telephone|telefon\w*|téléphone|teléfono|mobile|mobil|handy|cell|portable|móvil|call|ruf\w*|anruf\w*|appel\w*|llam\w+|fax|whatsapp|sms",
    )
)
#: Words near a number that speak against all kinds.
COUNTERS = re.compile(r"\b(?:order|invoice|isbn|issn|version|ver|ticket|serial|sku|part|item|article|section|page|price|total|amount|build|release|bestell\w*|rechnung\w*|preis|artikel\w*|commande|facture|prix|pedido|factura|precio|doi|id)\b|[$€£#§]", re.I)
#: Frequent ends of host names.
ENDS = frozenset("com org net edu gov mil int info biz name io co ai app dev me tv eu de fr es it uk us ca au nz ch at be nl se no dk fi pl cz sk hu ro bg gr pt ie ru ua tr il in cn jp kr br mx ar cl pe za".split())
#: Calling codes of one and two digits; the others have three and begin with these.
CODES = re.compile(r"1|7|2[07]|3[0123469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|(?:2[1-689]|3[578]|42|5[09]|6[789]|8[0578]|9[679])[0-9]")
#: Issuer prefixes of payment cards.
ISSUERS = re.compile(r"4|5[1-5]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)|3[47]|3(?:0[0-5]|095|6|[89])|35(?:2[89]|[3-8])|6(?:011|4[4-9]|5|2)")


class Span(NamedTuple):
    kind: int
    start: int
    end: int
    votes: int
    features: int


def luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(int(d) for d in digits[-1::-2])) % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base rules, by kind, then start; code points, end exclusive."""
    out = []
    if "@" in text:
        free = 0  # local parts begin here at the earliest
        for m in _HOST.finditer(text):
            low = max(free, text.rfind("@", free, m.start()) + 1)
            local = len(text[low : m.start()]) - len(text[low : m.start()].rstrip(LOCAL))
            if local:
                out.append((EMAIL, m.start() - local, m.end()))
                free = m.end()
    if "." in text:
        for m in _QUAD.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append((IP, *m.span()))
    for m in _DIGITS.finditer(text):
        digits = only_digits(m.group()) if m.end() - m.start() <= 37 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((CARD, *m.span()))
    if "+" in text:
        for m in _PLUS.finditer(text):
            end = m.start() + len(m.group().rstrip(" ().-"))
            if end - m.start() >= 4 and 9 <= len(only_digits(text[m.start() : end])) <= 15:
                out.append((PHONE, m.start(), end))
    return out


def loose_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates that no base span overlaps, from left to right."""
    found = []
    if re.search(r"[\[({<]", text):
        found += [(EMAIL, *m.span()) for m in _SPELT.finditer(text)] + [(IP, *m.span()) for m in _BRACKETED.finditer(text)]
    if ":" in text:
        found += [(IP, *m.span()) for m in _SIX.finditer(text) if m.group().count(":") == 7 or m.group().count("::") == 1]
    for m in _NUMBER.finditer(text):
        digits = only_digits(m.group()) if m.end() - m.start() <= 60 else ""
        if 13 <= len(digits) <= 19 and (len(digits) > 15 or luhn(digits) or CUES[CARD].search(text, max(0, m.start() - 48), m.start())):
            found.append((CARD, *m.span()))
        elif 7 <= len(digits) <= 15:
            found.append((PHONE, *m.span()))
    taken = sorted((s, e) for _, s, e in base)
    out, at, free = [], 0, 0
    for kind, start, end in sorted(found, key=lambda x: (x[1], -x[2], x[0])):
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        if start >= free and not (at < len(taken) and taken[at][0] < end):
            out.append((kind, start, end))
            free = end
    return out


def judged(text: str, kind: int, start: int, end: int, strict: bool) -> Span:
    """The votes on a candidate and its features (one bit each)."""
    span = text[start:end]
    digits = only_digits(span) if len(span) <= 512 else ""
    low = max(0, start - 48)
    cue = bool(CUES[kind].search(text, low, start))
    counter = kind != EMAIL and bool(COUNTERS.search(text, max(0, start - 24), start))
    before, after = text[start - 1 : start], text[end : end + 1]
    glued = before.isalnum() or after.isalnum() or before in ("_", "=", "/") or after in ("_", "=")
    date, same = bool(_DATE.match(span)), len(set(digits)) == 1
    if kind == EMAIL:
        end_word = re.split(r"[^a-z0-9-]+", span.lower().rstrip(")]}> "))[-1]
        rule, known = end_word.isalpha() and 2 <= len(end_word) <= 24, end_word in ENDS
    elif kind == IP:
        parts = re.split(r"\[\.\]|\.", span) if ":" not in span else []
        rule = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)
        known = ":" in span or 1 <= int(parts[0].lstrip("0")[:3] or 0) <= 223
    elif kind == CARD:
        rule, known = luhn(digits), bool(ISSUERS.match(digits))
    else:
        rule = 9 <= len(digits) <= 15 and not same
        known = bool(CODES.match(digits[2:] if digits.startswith("00") else digits)) if span[0] == "+" or digits.startswith("00") else digits[:1] == "0" or (len(digits) == 10 and digits[0] > "1")
    votes = (
        2 if strict else 0 if date or same else 1,
        2 if rule else 0,
        2 if known else 0,
        2 if cue else 1 if strict else 0,
        0 if counter else 1,
        0 if glued else 2,
    )
    n = len(digits)
    flags = [kind == k for k in range(4)] + [strict, rule, known, cue, counter, glued, date, same]
    flags += [n <= 6, 7 <= n <= 8, 9 <= n <= 10, 11 <= n <= 12, 13 <= n <= 15, n >= 16]
    flags += [c in span for c in " .-(/:@"] + [span[0] == "+", span[:2] == "00", span[0] == "(", not before, not after, before.isspace(), after.isspace()]
    flags += [kind == k and cue for k in range(4)] + [kind == k and rule for k in range(4)]
    return Span(kind, start, end, sum(v * 3**i for i, v in enumerate(votes)), sum(1 << i for i, f in enumerate(flags) if f))


#: How many bits features have.
FEATURES = 40


class Reliability(NamedTuple):
    """chance[kind, pattern]: that such votes mean personal data; right[kind, labeler]: how
    often a labeler that votes is right."""

    chance: np.ndarray
    right: np.ndarray


def estimate(counts: np.ndarray, steps: int = 60, prior: tuple[float, float] = (8.0, 2.0)) -> Reliability:
    """Expectation-maximisation over counts[kind, pattern].

    Each kind has its own share of personal data and, for each labeler and either class,
    chances of its three votes. Pseudo-counts, prior right and wrong votes each, keep
    labelers that seldom vote near where they were.
    """
    votes = np.arange(PATTERNS)[:, None] // 3 ** np.arange(len(LABELERS)) % 3
    chosen = votes[:, :, None] == np.arange(3)  # pattern, labeler, vote
    good, bad = prior
    start = np.array([[good, good, bad], [bad, good, good]])  # class, vote
    chance, right = np.zeros((len(KINDS), PATTERNS)), np.zeros((len(KINDS), len(LABELERS)))
    for kind, n in enumerate(counts):
        share = 0.5
        theta = np.repeat((start / start.sum(axis=1, keepdims=True))[:, None, :], len(LABELERS), axis=1)
        for _ in range(steps):
            logs = np.stack([(np.log(theta[c])[None] * chosen).sum(axis=(1, 2)) for c in (0, 1)]) + np.log([[1 - share], [share]])
            post = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -60, 60)))
            weight = np.stack([n * (1 - post), n * post])
            share = (weight[1].sum() + 1) / (n.sum() + 2)
            told = np.einsum("cp,plv->clv", weight, chosen) + start[:, None, :]
            theta = told / told.sum(axis=2, keepdims=True)
        chance[kind] = post
        told = np.einsum("cp,plv->clv", weight, chosen)
        right[kind] = (told[1, :, 2] + told[0, :, 0] + good) / (told[:, :, 2].sum(axis=0) + told[:, :, 0].sum(axis=0) + good + bad)
    return Reliability(chance, right)


def bits(features: np.ndarray) -> np.ndarray:
    return ((features[:, None] >> np.arange(FEATURES)) & 1).astype(np.float64)


def train(features: np.ndarray, target: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights (the last is the bias) of a logistic regression on soft targets, by Newton."""
    x = np.concatenate([bits(features), np.ones((len(features), 1))], axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(h, x.T @ (p - target) + ridge * w)
    return w


def likelihood(features: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(bits(features) @ weights[:-1] + weights[-1], -30, 30)))



CANDIDATE = "array<struct<kind:int,start:long,end:long,votes:int,features:long,base:boolean>>"


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and spans: the base spans and looser candidates of each whole text, with votes and
    features. Null text is empty."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("votes", pa.int32()), ("features", pa.int64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch["text"].to_pylist():
                text = text or ""
                base = base_spans(text)
                here = [{**judged(text, *s, True)._asdict(), "base": True} for s in base]
                out.append(here + [{**judged(text, *s, False)._asdict(), "base": False} for s in loose_spans(text, base)])
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(out, kind)], ["id", "spans"])

    return rows.mapInArrow(run, f"id {id_type}, spans {CANDIDATE}")


def learn(found: DataFrame, most: int = 20000) -> tuple[Reliability, np.ndarray]:
    """Reliabilities from the vote counts of all candidates, and the classifier's weights
    from the `most` candidates with the smallest hashes."""
    spans = found.select("id", F.explode("spans").alias("s")).select("id", "s.*")
    counts = np.zeros((len(KINDS), PATTERNS))
    for r in spans.groupBy("kind", "votes").count().collect():  # 4 x 729 rows at most
        counts[r["kind"], r["votes"]] = r["count"]
    told = estimate(counts)
    order = ["hash", "id", "kind", "start", "votes", "features"]
    sample = spans.withColumn("hash", F.xxhash64("id", "kind", "start")).select(*order).orderBy(*order).limit(most).toArrow()
    kind, votes, features = (sample[c].to_numpy().astype(np.int64) for c in ("kind", "votes", "features"))
    return told, train(features, told.chance[kind, votes])


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", at_least: float = 0.5) -> DataFrame:
    """id_col, base and added (arrays of kind, start, end) for each row of docs.

    Base spans are those of the rules; added ones are candidates that no base span overlaps
    and to which the classifier gives at_least. Offsets are code points, ends exclusive.
    Null and empty texts have no spans. Repeated rows and null ids are rows like others;
    other columns are ignored, whatever their names. An empty table gives no rows.

    One pass over the texts stages the candidates; all that follows reads these.
    """
    found = staged(candidates(docs, id_col, text_col), "candidates")
    weights = learn(found)[1]
    id_type = found.schema["id"].dataType.simpleString()
    one = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch["spans"].to_pylist()
            flat = np.array([s["features"] for some in spans for s in some], np.int64)
            chance = iter(likelihood(flat, weights).tolist())
            base, added = [], []
            for some in spans:
                said = [(s, next(chance)) for s in some]
                shown = lambda s: {"kind": KINDS[s["kind"]], "start": s["start"], "end": s["end"]}
                base.append([shown(s) for s, _ in said if s["base"]])
                added.append([shown(s) for s, p in said if not s["base"] and p >= at_least])
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(base, one), pa.array(added, one)], ["id", "base", "added"])

    kind = "array<struct<kind:string,start:long,end:long>>"
    return found.mapInArrow(run, f"id {id_type}, base {kind}, added {kind}").withColumnRenamed("id", id_col)


def _of(spans, kind: str):
    return F.filter(spans, lambda s: s["kind"] == kind)


def _joined(spans):
    """`kind:start:end` by kind as listed in KINDS, then start."""
    ordered = [F.transform(F.array_sort(_of(spans, k)), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])) for k in KINDS]
    return F.array_join(F.concat(*ordered), ",")


def personal_query(docs: DataFrame) -> DataFrame:
    """The base spans' numbers and digest, and all spans."""
    found = find_personal(docs)
    numbers = [F.size(_of(F.col("base"), k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *numbers, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "added")).alias("spans"))
