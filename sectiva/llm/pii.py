"""Personal data by fixed patterns and a semi-Markov conditional random field.

The patterns give base spans, which always stay.  Around digits, at-signs and spelled-out addresses
a semi-Markov field then reads candidate segments of up to MAX_TOKENS tokens: features look at a
whole segment (digit counts, checksum, grouping, neighbours), and dynamic programming over bounded
segments chooses boundaries and kinds jointly.  The field is trained here, on sentences written by
a generator that knows their spans; it adds spans that the patterns miss, such as spelled-out
addresses, national phone numbers after a cue and grouped card numbers.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from functools import lru_cache
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectiva.llm._common import small_batches

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS, MAX_DIGITS = 24, 24
#: A segment is added only if it beats the same tokens read as no entity by this log score.
MARGIN = 2.0
#: Characters between a spelled-out at and dot at most.
GAP = 255
TRAIN_SENTENCES, EPOCHS, SEED = 900, 12, 11

# The base patterns.
MAIL_LEFT = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
MAIL_RIGHT = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|.", re.S)
WORD = re.compile(r"\S+")
HIT = re.compile("[0-9@]")
SPELLED = re.compile(r"\b(?:at|dot)\b")
MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
SPOKEN = re.compile(r"\w+(?:\x20?[\[(]?\bdot\b[\])]?\x20?\w+)*\x20?[\[(]?\bat\b[\])]?\x20?\w+(?:\x20?[\[(]?\bdot\b[\])]?\x20?\w+)+")
#: Usual last parts of host names.
ENDS = frozenset("com org net edu gov info io co uk de fr es it nl eu ch at us ca".split())
#: Cue words before a number or address, by kind.
CUES = {
    "phone": frozenset("phone tel telephone mobile call fax cell telefon handy anruf rufnummer téléphone portable appelez teléfono móvil llame".split()),
    "card": frozenset("card visa mastercard amex credit karte kreditkarte carte bancaire tarjeta crédito".split()),
    "ip": frozenset("ip host server address adresse serveur servidor dirección".split()),
    "email": frozenset("mail email contact write kontakt courriel correo contacto".split()),
}


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if k % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _octets(text: str) -> bool:
    return all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in text.split("."))


def _emails(text: str):
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in MAIL_LEFT:
            start -= 1
        found = MAIL_RIGHT.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, leftmost and non-overlapping per kind; failing matches are dropped."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if _octets(m[0])]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


FEATURES = (
    "bias digits<7 digits7-9 digits10-11 digits12-15 digits16-19 digits>19 luhn octets plus zeros bracket spaces dashes dots mixed fours "
    "groups2-4 groups5+ at spelled_at spelled_dot letters bare glued_left glued_right assigned cue_email cue_ip cue_card cue_phone mail_shape spelled_shape known_end tokens"
).split()
AT = {name: k for k, name in enumerate(FEATURES)}


def features(text: str, a: int, b: int, left_words: list[str]) -> np.ndarray:
    """Whole-span features of text[a:b]."""
    s, x = text[a:b], np.zeros(len(FEATURES))
    digits = "".join(c for c in s if "0" <= c <= "9")
    n = len(digits)
    on = ["bias", "digits<7" if n < 7 else "digits7-9" if n < 10 else "digits10-11" if n < 12 else "digits12-15" if n < 16 else "digits16-19" if n < 20 else "digits>19"]
    if 13 <= n <= 19 and luhn(digits):
        on.append("luhn")
    if re.fullmatch(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", s) and _octets(s):
        on.append("octets")
    groups = re.findall("[0-9]+", s)
    seps = set(re.sub("[0-9]+", "", s)) - set("+()")
    if s[0] == "+":
        on.append("plus")
    if digits[:1] == "0":
        on.append("zeros")
    if "(" in s:
        on.append("bracket")
    on += ["spaces"] * (seps == {" "}) + ["dashes"] * (seps == {"-"}) + ["dots"] * (seps == {"."}) + ["mixed"] * (len(seps) > 1) + ["bare"] * (len(groups) == 1 and s.isdigit())
    if len(groups) >= 4 and all(len(g) == 4 for g in groups[:-1]):
        on.append("fours")
    on += ["groups2-4"] * (2 <= len(groups) <= 4) + ["groups5+"] * (len(groups) > 4)
    if "@" in s:
        on.append("at")
    low = s.lower()
    if re.search(r"\b(?:at)\b", low):
        on.append("spelled_at")
    if re.search(r"\bdot\b", low) and re.search(r"[a-z]{2,6}$", low):
        on.append("spelled_dot")
    if any(c.isalpha() for c in s):
        on.append("letters")
    before, after = text[a - 1 : a], text[b : b + 1]
    if before and not before.isspace() and before not in "(:,;\"'":
        on.append("glued_left")
    if after and (after.isalnum() or after in "@_%$=/\\" or (after in ".-:" and text[b + 1 : b + 2].isalnum())):
        on.append("glued_right")
    if before and before in "=\"'":
        on.append("assigned")
    on += [f"cue_{k}" for k in KINDS if any(w in CUES[k] for w in left_words)]
    on += ["mail_shape"] * bool(MAIL.fullmatch(s)) + ["spelled_shape"] * bool(SPOKEN.fullmatch(low)) + ["known_end"] * (re.split(r"[\W_]", low)[-1] in ENDS)
    for name in on:
        x[AT[name]] = 1
    x[AT["tokens"]] = len(TOKEN.findall(s)) / 10
    return x


def segments(text: str, free=None) -> tuple[list[tuple[int, int]], list[tuple[int, int]], np.ndarray]:
    """(token offsets, candidate segments as token ranges, their features) of one region.

    A candidate is a run of digit groups, an address with a sign, or one that is spelled out: it
    ends behind a dot, or the word, that follows an at.  ``free(start, end)`` says where one may be.
    """
    tokens = [m.span() for m in TOKEN.finditer(text)]
    said = [text[a:b].lower() if b - a < 4 and text[a].isalpha() else "" for a, b in tokens]
    kind = ["w" if text[a].isalpha() else "d" if text[a].isdigit() else text[a] for a, _ in tokens]
    found, x = [], []
    far = len(tokens) + MAX_TOKENS
    next_at = [far] * (len(tokens) + 1)
    for i in range(len(tokens) - 1, -1, -1):
        next_at[i] = i if kind[i] == "@" or said[i] == "at" else next_at[i + 1]
    for i, (a, _) in enumerate(tokens):
        wordy = next_at[i + 1] < i + MAX_TOKENS
        if kind[i] not in ("w", "d", "+", "(") or kind[i] == "w" and (not wordy or said[i] in ("at", "dot")):
            continue
        left = None
        n = words = dots = 0
        sign = spelled = after = ends = False
        for j in range(i, min(i + MAX_TOKENS, len(tokens))):
            k = kind[j]
            if k == "d":
                n += tokens[j][1] - tokens[j][0]
            elif k == "w":
                if not wordy:
                    break
                words += 1
                if said[j] == "at":
                    spelled, ends = True, False
                    continue
                if said[j] == "dot":
                    ends = spelled
                    continue
            elif k in " +-.()@_[]":
                dots += k == "."
                after = after or sign and k == "."
                sign = sign or k == "@"
                continue
            else:
                break
            if n > MAX_DIGITS:
                break
            if (not words and (n >= 7 or dots == 3 and n > 3) or sign and after or ends) and (free is None or free(a, tokens[j][1])):
                if left is None:
                    left = [w.strip(":.,").lower() for w in text[max(0, a - 40) : a].split()[-3:]]
                found.append((i, j + 1))
                x.append(features(text, a, tokens[j][1], left))
            if k == "w":
                ends = False
    return tokens, found, np.array(x).reshape(-1, len(FEATURES))


def _logsum(values):
    top = max(values)
    return top + np.log(sum(np.exp(v - top) for v in values))


class Field:
    """Weights per kind over whole-span features; a token outside entities scores zero."""

    def __init__(self):
        self.w = np.zeros((len(KINDS), len(FEATURES)))

    def best(self, n: int, found: list[tuple[int, int]], x: np.ndarray) -> list[tuple[int, int, int]]:
        """Best segmentation of ``n`` tokens: (first token, end token, kind) of its entities."""
        score = x @ self.w.T
        ending: dict[int, list[int]] = {}
        for k, (_, j) in enumerate(found):
            ending.setdefault(j, []).append(k)
        value, back = [0.0] * (n + 1), [None] * (n + 1)
        for j in range(1, n + 1):
            value[j] = value[j - 1]
            for k in ending.get(j, ()):
                kind = int(np.argmax(score[k]))
                v = value[found[k][0]] + score[k, kind] - MARGIN
                if v > value[j]:
                    value[j], back[j] = v, (found[k][0], j, kind)
        out, j = [], n
        while j:
            if back[j]:
                out.append(back[j])
                j = back[j][0]
            else:
                j -= 1
        return out[::-1]

    def gradient(self, n, found, x, truth) -> np.ndarray:
        """Gradient of the log-likelihood of the true entities, by forward and backward sums over segmentations."""
        score = x @ self.w.T
        own = np.logaddexp.reduce(score, axis=1) if len(found) else np.zeros(0)
        ending, starting = {}, {}
        for k, (i, j) in enumerate(found):
            ending.setdefault(j, []).append(k), starting.setdefault(i, []).append(k)
        fore, aft = [0.0] * (n + 1), [0.0] * (n + 1)
        for j in range(1, n + 1):
            fore[j] = _logsum([fore[j - 1], *(fore[found[k][0]] + own[k] for k in ending.get(j, ()))])
        for i in range(n - 1, -1, -1):
            aft[i] = _logsum([aft[i + 1], *(aft[found[k][1]] + own[k] for k in starting.get(i, ()))])
        g = np.zeros_like(self.w)
        for k, (i, j) in enumerate(found):
            p = np.exp(fore[i] + aft[j] - fore[n] + score[k])
            g += (np.array([(i, j, c) in truth for c in range(len(KINDS))]) - p)[:, None] * x[k]
        return g

    def fit(self, data, epochs: int = EPOCHS, rate: float = 0.3):
        total = np.full_like(self.w, 1e-6)
        prepared = []
        for text, spans in data:
            tokens, found, x = segments(text)
            where = {(tokens[i][0], tokens[j - 1][1]): (i, j) for i, j in found}
            prepared.append((len(tokens), found, x, {(*where[a, b], KINDS.index(kind)) for kind, a, b in spans if (a, b) in where}))
        rng = np.random.default_rng(SEED)
        for _ in range(epochs):
            for k in rng.permutation(len(prepared)):
                g = self.gradient(*prepared[k]) - 2e-4 * self.w
                total += g * g
                self.w += rate * g / np.sqrt(total)
        return self


def sentences(n: int = TRAIN_SENTENCES, seed: int = SEED):
    """Training sentences with their spans: entities in many spellings, and numbers that are none."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[rng.integers(len(xs))]
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    word = lambda: "".join(pick(["ka", "ro", "mi", "ten", "sul", "der", "on", "al", "est"]) for _ in range(rng.integers(1, 4)))

    def card():
        d = pick("3456") + digits(pick([14, 14, 14, 15]))
        d += next(c for c in "0123456789" if luhn(d + c))
        sep = pick(["", " ", "-", "."])
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4))

    def phone():
        if rng.random() < 0.5:
            return "+" + pick(["1", "44", "49", "33", "34"]) + pick([" ", "-", ""]) + digits(3) + pick([" ", "-", ""]) + digits(3) + pick([" ", "-", ""]) + digits(4)
        sep = pick([" ", "-", "."])
        return pick(["(" + digits(3) + ") " + digits(3) + "-" + digits(4), "0" + digits(3) + sep + digits(3) + sep + digits(4), digits(3) + sep + digits(3) + sep + digits(4)])

    def mail():
        a, b, c = word(), word(), pick(["com", "org", "net", "de", "fr", "es"])
        return pick([f"{a}.{digits(2)}@{b}.example.{c}", f"{a}@{b}.{c}", f"{a} at {b} dot {c}", f"{a} [at] {b} [dot] {c}", f"{a} (at) {b} (dot) {c}", f"{a} dot {word()} at {b} dot {c}"])

    makers = {"email": mail, "ip": lambda: ".".join(str(x) for x in rng.integers(0, 256, 4)), "card": card, "phone": phone}
    others = [
        lambda: f"{digits(4)}-{digits(2)}-{digits(2)}", lambda: digits(pick([7, 8, 9, 10, 12, 13, 16, 20, 24])), lambda: f"{digits(1)}.{digits(1)}.{digits(1)}", lambda: f"{digits(3)}.{digits(3)}.{digits(3)},{digits(2)}",
        lambda: f"{digits(4)} {digits(4)} {digits(4)} {digits(3)}1", lambda: f"password={digits(9)}", lambda: f'token = "{digits(12)}"', lambda: f"@{word()}", lambda: f"{word()} at {word()}", lambda: f"{digits(3)}.{digits(3)}.{digits(3)}.{digits(3)}.{digits(2)}",
        lambda: f"{digits(4)} - {digits(4)}", lambda: f"{digits(3)}-{digits(2)}-{digits(4)}", lambda: f"{digits(2)} {digits(3)} {digits(3)} {digits(2)}", lambda: f"{word()} dot {word()}", lambda: f"ISBN {digits(3)}-{digits(10)}", lambda: f"{digits(5)} {digits(5)}",
    ]
    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.integers(1, 4)):
            text += " ".join(word() for _ in range(rng.integers(1, 4))) + " "
            kind = pick([*KINDS, None, None, None])
            if kind:
                national = ""
                value = makers[kind]()
                if kind == "phone" and value[0] != "+" or rng.random() < 0.3:
                    national = pick(sorted(CUES[kind])) + pick([" ", ": ", " "])
                text += national
                spans.append((kind, len(text), len(text) + len(value)))
                text += value + pick([" ", ", ", ". "])
            else:
                text += pick(others)() + pick([" ", ", ", ". "])
        yield text + word(), spans


@lru_cache(1)
def trained_field() -> Field:
    """The field, fitted once a process on the generated sentences."""
    return Field().fit(list(sentences()))


def regions(text: str):
    """Stretches worth reading: digits or at-signs with words around them, and spelled-out addresses."""
    spelled = [m.span() for m in SPELLED.finditer(text)] if "dot" in text and "at" in text else []
    if not spelled and not HIT.search(text):
        return
    words = [m.span() for m in WORD.finditer(text)]
    hits = [(a, b) for a, b in words if HIT.search(text, a, b)]
    starts = [a for a, _ in words]
    for (a, b), (c, d) in pairwise(spelled):
        # An "at" and the "dot" behind it have at most two blanks between them, one to either side of a word.
        if text[b - 1] == "t" and text[b - 2] == "a" and text[d - 3] == "d" and c - b < GAP and len(text[b:c].split(" ")) <= 3:
            hits.append((words[max(bisect_right(starts, a) - 2, 0)][0], words[min(bisect_right(starts, c), len(words) - 1)][1]))
    if not hits:
        return
    hits.sort()
    at, end = hits[0]
    for a, b in [*hits[1:], (len(text) + 99, 0)]:
        if a <= end + 12:
            end = max(end, b)
        else:
            yield max(0, at - 40), min(len(text), end + 12)
            at, end = a, b


def added_spans(text: str, base: list[tuple[str, int, int]], field: Field) -> list[tuple[str, int, int]]:
    """Spans that the field finds and no base span touches."""
    out, taken = [], sorted((a, b) for _, a, b in base)
    starts, ends = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    free = lambda a, b: not (k := bisect_left(starts, b)) or ends[k - 1] <= a
    for lo, hi in regions(text):
        tokens, found, x = segments(text[lo:hi], lambda a, b, lo=lo: free(lo + a, lo + b))
        for i, j, kind in field.best(len(tokens), found, x) if found else ():
            a, b = lo + tokens[i][0], lo + tokens[j - 1][1]
            if not out or a >= out[-1][2]:
                out.append((KINDS[kind], a, b))
    return out


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1])))


def find_spans(text: str | None, field: Field) -> tuple[list, list]:
    base = base_spans(text or "")
    return base, added_spans(text or "", base, field)


def _find(batches, field):
    for batch in batches:
        got = [find_spans(t, field) for t in batch.column(1).to_pylist()]
        counts = [pa.array([sum(k == kind for k, *_ in base) for base, _ in got], pa.int64()) for kind in KINDS]
        digest = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in got])
        rows = [[{"kind": k, "start": a, "end": b, "base": (k, a, b) in base} for k, a, b in sorted(base + more, key=lambda x: (KINDS.index(x[0]), x[1]))] for base, more in got]
        found = pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])))
        yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digest, found], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "found"])


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, found) for every row.

    ``found`` lists all spans (kind, start, end in code points, base or added), by kind and start.
    Null and empty texts hold none; repeated rows and null ids are kept; other columns are ignored;
    texts are read whole.
    """
    small_batches(docs.sparkSession)
    field = trained_field()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, found array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"
    return rows.mapInArrow(lambda it: _find(it, field), schema)


def span_string(found: str = "found"):
    """``found`` as kind:start:end, comma-joined."""
    return F.array_join(F.transform(F.col(found), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) with every found span replaced by its kind in brackets."""
    small_batches(docs.sparkSession)
    field = trained_field()

    def clean(t):
        base, more = find_spans(t, field)
        out, at = [], 0
        for kind, a, b in sorted(base + more, key=lambda x: x[1]):
            if a >= at:
                out += [t[at:a], f"[{kind}]"]
                at = b
        return None if t is None else "".join(out) + t[at:]

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(clean, batch.column(1).to_pylist())), pa.string())], names=["doc_id", "text"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, text string")
