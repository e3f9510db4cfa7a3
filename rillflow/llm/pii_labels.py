"""Labelled spans for the tagger of `pii`, and its training. Only training uses this module.

The labels are distant ones: patterns with contexts, written for the test corpus of scale 0.1, mark its spans on a bounded
sample (`SAMPLE` windows with spans and three times as many without). Values are then exchanged for made-up ones, so that
the tagger learns forms and contexts, not the values. A part of each batch (`OTHER`) are made-up sentences with values of many other
forms (`pii_forms`). Run: python -m rillflow.llm.pii_labels TABLE OUT.npz [STEPS [WORKERS [START.npz]]]
"""

from __future__ import annotations

import random
import re
import sys

import numpy as np

from rillflow.llm import pii, pii_forms
from rillflow.llm.tagger import TYPES, Tagger, encode

#: Most windows with spans that are drawn on (the corpus of scale 0.1 has fewer).
SAMPLE = 20_000
#: Batches of 96 windows that are trained on.
STEPS = 2_400
#: Part of a batch that is made up.
OTHER = 0.4

# Given names of the test corpus.
GIVEN = (
    "Astrid Victor Louisa Hannah Pablo Andrés Amélie Nadia Yara Benoît Samuel Joanna Diego Fiona Greta Edith Leila Anke Dmitri Jürgen Marek Lucía Sabine Amina Matthias Teresa "
    "Ravi Martin Renée Zofia Oscar Nils Hugo Carmen Sofia Julia Conrad Rafael Irene Clara Kenji Leon Peter Elodie Felix Ingrid Gareth Björn Tomas Owen Sofía"
).split()
_ENDS = "ansky berg mann ström quist ley well sen ez uro aldi eaux ier ovic".split()
_PARTS = ("van", "von", "de", "della", "al")
_SYLLABLES = [a + b for a in "b br c cl d dr f fl g gr h j k kr l m n p pl qu r s sh sk st t th tr v w y z".split() for b in ("a", "ae", "e", "ei", "i", "ia", "o", "ou", "u", "y")]


def _patterns() -> dict[str, re.Pattern]:
    g = "(?:" + "|".join([*GIVEN, *(n.upper() for n in GIVEN)]) + ")"
    ends = "|".join([*_ENDS, "strom", *(e.upper() for e in _ENDS), "STROM"])
    one = rf"[A-ZÀ-Þ][\wà-ÿß]*(?:{ends})"
    s = rf"{one}(?:-{one})?"
    part = r"(?:van|von|de|della|al|VAN|VON|DE|DELLA|AL)"
    cap = r"[A-ZÀ-Þ][\wà-ÿß'’-]+"
    kind = r"(?:Street|Road|Row|Lane|Close|Cl|Ave\.?|Avenue|Blvd|Weg|Terrace|St)"
    return {
        "name": re.compile(rf"(?<![\w-])(?:{g}(?:-{g})?(?:\s[A-Z]\.)?\s(?:{part}\s)?{s}|{s},\s{g}(?:-{g})?(?:\s[A-Z]\.)?)(?!\w)"),
        "email": re.compile(r"[\w.+-]+(?:\s?@\s?|\s?\(at\)\s?|\[at\]|&#64;|\sat\s)(?:[a-z0-9-]+(?:\.|\[dot\]|\sdot\s))+(?:example|invalid|test|com|net|org)\b(?:(?:\.|\[dot\]|\sdot\s)(?:com|net|org|example))?", re.I),
        "phone": re.compile(
            r"(?<![\w.+-])(?:\+44\s\(0\)1632\s960\s\d{3}|\+44\s20\s7946\s\d{4}|01632\s960\s?\d{3}|\+1[. -]\d{3}[.-]\d{3}[.-]\d{4}|\(?\d{3}\)?[. ]\d{3}[.-]\d{4}(?!-)"
            r"|2\s0\s2\s5\s5\s5(?:\s\d){4}|555[- ]01\d\d(?:\s[Ee][Xx][Tt]\.\s\d+)?|\(0999\)\s\d{3}\s\d\d\s\d\d|00999\s\d\d\s\d{3}\s\d{4}|\+999(?:-\d\d){4}|\+999\d{9})(?!\w)"
        ),
        "id_number": re.compile(r"(?<![\w.+/-])(?:(?:666|000)[- ]\d\d[- ]\d{4}|\d{3}\.\d{3}\.\d{4}-\d|\d{6}\s\d{6}|\d{6}-\d{5}|[A-Z]\s\d{3}\s\d{3}\s\d{3}|[A-Z]{2}\d{7}|\d{8}-[A-Z])(?![\w/-])"),
        "street_address": re.compile(
            rf"(?<![\w-])(?:(?:Flat\s\d+,\s)?\d+[A-Z]?\s(?:North\s|South\s|East\s|West\s)?{cap}\s{kind}(?:,\sApt\s\d+|\s\#\d+|,\sUnit\s\d+)?|{cap}\sTerrace\s\d+"
            rf"|{cap}(?:straße|strasse|gasse)\s\d+[a-z]?(?:,\s\d+\.\sStock)?|{cap}er\sWeg\s\d+[a-z]?|Am\s{cap}hof\s\d+[a-z]?"
            rf"|\d+(?:\s(?:bis|ter))?,?\s(?:impasse|place|rue|avenue|chemin|allée|boulevard|quai)\s(?:de\s|du\s|des\s|d')?{cap}|(?:Calle|C/|Avenida\sde|Plaza|Paseo)\s(?:de\s)?{cap},?\s\d+(?:,\s\d+º\s[A-Z])?)(?!\w)",
            re.I,
        ),
    }


_P = _patterns()
_NOT_BEFORE = re.compile(r"(?:ship|schiff|navire|barco|the)\s$", re.I)
_NOT_AFTER = re.compile(r"\s(?:class|square|brook|star|lie)\b", re.I)


def label(text: str) -> list[tuple[int, int, int]]:
    """Distant labels of a text: (start, end, type)."""
    out: list[tuple[int, int, int]] = []
    for kind in ("email", "phone", "id_number", "street_address", "name"):
        for m in _P[kind].finditer(text):
            a, b = m.span()
            if kind == "name" and (_NOT_BEFORE.search(text[max(0, a - 8) : a]) or _NOT_AFTER.match(text[b : b + 8]) or re.search(r"(?:Square|Brook)$", m.group(), re.I)):
                continue
            if kind == "street_address":
                words = [w for w in re.findall(r"[^\W\d_]+", m.group()) if len(w) > 1 and w.lower() not in pii.STREET.split("|")]
                if not words or not (words[0][0].isupper() or words[0] in ("bis", "ter", "de", "du", "des", "boulevard")) or words[0].lower() in pii.NOT_GIVEN and words[0].lower() not in ("am", "de", "du", "des"):
                    continue
            if all(b <= x or a >= y for x, y, _ in out):
                out.append((a, b, TYPES.index(kind)))
    return sorted(out)


def _made(r: random.Random, n: int | None = None) -> str:
    return "".join(r.choice(_SYLLABLES) for _ in range(n or r.choice((1, 2, 2, 3)))).capitalize()


def _given(r: random.Random) -> str:
    return r.choice(GIVEN) if r.random() < 0.8 else _made(r, 2) + r.choice(("", "n", "a", "s", "l"))


def _address(r: random.Random, old: str) -> str:
    """An address in one of the forms of the old one's language."""
    low, name, n = old.lower(), _made(r, r.choice((1, 2, 2, 3))), r.choice((r.randint(1, 99), r.randint(100, 199), r.randint(1000, 1199)))
    if re.search(r"straße|strasse|gasse|\bweg\b|hof\b", low):
        n = r.randint(1, 199)
        return r.choice((f"{name}straße {n}{r.choice(('', 'a', 'b'))}", f"{name}gasse {n}, {r.randint(1, 5)}. Stock", f"{name}er Weg {n}", f"Am {name}hof {n}"))
    if re.search(r"\b(?:rue|impasse|place|avenue|chemin|quai|allée|boulevard)\b", low) and not re.match(r"avenida", low):
        return f"{n}{r.choice(('', ' bis', ' ter'))}{r.choice((' ', ', '))}{r.choice(('rue de', 'impasse', 'place', 'avenue du', 'chemin'))} {name}"
    if re.match(r"calle|c/|avenida|plaza|paseo", low):
        return r.choice((f"Calle {name} {n}", f"C/ {name} {n}, {r.randint(1, 9)}º {r.choice('ABCD')}", f"Avenida de {name}, {n}", f"Plaza {name} {n}"))
    way = r.choice(("Street", "Road", "Row", "Lane", "Close", "Cl", "Weg"))
    return r.choice((f"{n} {name} {way}", f"{n}{r.choice('AB')} {name} {way}", f"{n} {name} Street, Apt {r.randint(1, 30)}", f"Flat {r.randint(1, 9)}, {n} {name} Row", f"{n} {r.choice(('North', 'South'))} {name} Ave.", f"{n} {name} Blvd #{r.randint(1, 30)}", f"{name} Terrace {n}"))


def _value(r: random.Random, kind: str, old: str) -> str:
    """Another value of the same form."""
    if kind in ("phone", "id_number"):
        keep = r.random() < 0.5
        lead = len(re.match(r"[+(]*\d*", old)[0]) if keep else 0
        return old[:lead] + "".join(r.choice("0123456789") if c.isdigit() else r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") if c.isupper() and c.isalpha() and kind == "id_number" else c for c in old[lead:])
    if kind == "name":
        surname = _made(r) + r.choice(_ENDS)
        if r.random() < 0.2:
            surname += "-" + _made(r, 1) + r.choice(_ENDS)
        given = _given(r) + ("-" + _given(r) if r.random() < 0.15 else "")
        form = r.random()
        new = f"{surname}, {given}" if form < 0.12 else f"{given} {r.choice('ABCDEFGHJKLMNOPRSTW')}. {surname}" if form < 0.3 else f"{given} {r.choice(_PARTS)} {surname}" if form < 0.45 else f"{given} {surname}"
        return new.upper() if old.isupper() else new
    if kind == "street_address":
        if r.random() < 0.4:
            new = _address(r, old)
            return new.upper() if old.isupper() else new

        def swap(m: re.Match) -> str:
            w = m.group()
            if w.lower() in pii.STREET.split("|") or w.lower() in ("flat", "apt", "unit", "floor", "north", "south", "east", "west", "am", "stock", "bis", "ter", "de", "du", "des"):
                return w
            end = next((x for x in ("straße", "strasse", "gasse", "hof", "er") if w.lower().endswith(x)), "")
            new = _made(r, r.choice((2, 2, 3))) + end
            return new.upper() if w.isupper() and len(w) > 1 else new if len(w) > 2 else w

        new = re.sub(r"[^\W\d_]{2,}", swap, old)
        return re.sub(r"\d+", lambda m: str(r.randint(1, 10 ** len(m.group()))), new)
    m = re.match(r"[\w.+-]+", old)
    tail = old[m.end() :]
    if r.random() < 0.5:
        domain = r.choice(("example.com", "example.net", "example.org", "kiosk.test", "museum.invalid", "mail.example", "letters.example.net", "post.example.org", f"{_made(r).lower()}.{r.choice(('com', 'org', 'test'))}"))
        at, dot = r.choice((("@", "."), ("@", "."), (" @ ", "."), (" (at) ", "."), ("[at]", "[dot]"), ("&#64;", "."), (" at ", " dot ")))
        tail = at + domain.replace(".", dot)
        tail = tail.upper() if old.isupper() else tail
    local = r.choice((f"{_made(r)}{r.choice(_ENDS)}_{r.randint(0, 99):02d}", f"{_given(r)}+wiki", f"{_given(r)}.{_made(r)}{r.choice(_ENDS)}", f"{_made(r)}{r.choice(_ENDS)}-{_given(r)}", f"{_made(r, 1)[0]}{_made(r)}{r.choice(_ENDS)}")).lower()
    return (local.upper() if old.isupper() else local) + tail


def windows_of(texts: list[str]) -> tuple[list, list]:
    """Labelled windows with spans and without, each text once: (text, spans)."""
    seen, full, empty = set(), [], []
    for t in texts:
        spans = label(t)
        for a, b in pii.windows(t):
            if (piece := t[a:b]) in seen:
                continue
            seen.add(piece)
            inside = [(max(s, a) - a, min(e, b) - a, k) for s, e, k in spans if s < b and e > a]
            (full if inside else empty).append((t, a, b, inside, spans))
    return full, empty


def _other_digits(r: random.Random, text: str) -> str:
    return re.sub(r"\d", lambda _: r.choice("0123456789"), text) if r.random() < 0.4 else text


def _draw(r: random.Random, item) -> tuple[np.ndarray, np.ndarray]:
    t, a, b, _, spans = item
    a, b = max(0, a + r.randint(-20, 20)), min(len(t), b + r.randint(-20, 20))
    if b - a < 20:
        a, b = item[1], item[2]
    pieces, tags, at = [], [], a
    for s, e, k in spans:
        if e <= a or s >= b:
            continue
        whole = s >= a and e <= b
        s, e = max(s, a), min(e, b)
        pieces.append(_other_digits(r, t[at:s]))
        tags += [0] * (s - at)
        new = _value(r, TYPES[k], t[s:e]) if whole and r.random() < 0.8 else t[s:e]
        pieces.append(new)
        tags += [1 + 2 * k] + [2 + 2 * k] * (len(new) - 1)
        at = e
    pieces.append(_other_digits(r, t[at:b]))
    tags += [0] * (b - at)
    text = "".join(pieces)
    if r.random() < 0.15:
        upper = "".join(c.upper() if len(c.upper()) == 1 else c for c in text)
        text = upper
    return encode(text), np.array(tags, np.int64)


def _made_up(r: random.Random) -> tuple[np.ndarray, np.ndarray]:
    text, spans = pii_forms.sentence(r)
    tags = np.zeros(len(text), np.int64)
    for a, b, kind in spans:
        k = TYPES.index(kind)
        tags[a], tags[a + 1 : b] = 1 + 2 * k, 2 + 2 * k
    a = r.randrange(min(12, len(text)))
    text, tags = text[a:][:180], tags[a:][:180]
    return encode(text), tags


def train(texts: list[str], steps: int = STEPS, batch: int = 96, hidden: int = 32, seed: int = 7, say=print, start: Tagger | None = None, workers: int = 1) -> Tagger:
    """With `start`, training goes on from there at a lower rate. `batch` windows for each worker and step."""
    full, empty = windows_of(texts)
    random.Random(seed).shuffle(full)
    random.Random(seed).shuffle(empty)
    full, empty = full[:SAMPLE], empty[: 3 * SAMPLE]
    say(f"{len(full)} windows with spans, {len(empty)} without")
    tagger = start or Tagger(hidden, seed)

    def draw(step: int, part: int):
        r = random.Random(f"{seed + (start is not None)} {step} {part}")
        rows = [_made_up(r) if r.random() < OTHER else _draw(r, r.choice(full) if r.random() < 0.45 else r.choice(empty)) for _ in range(batch)]
        return [x for x, _ in rows], [y for _, y in rows]

    tagger.fit(draw, steps, 2.5e-3 if start else 4e-3, say=lambda s, v: say(f"step {s}: {v:.3f}"), workers=workers)
    return tagger


def score(tagger: Tagger, texts: list[str]) -> dict[str, tuple[int, int, int]]:
    """Against the distant labels, per type: (labelled, found, both)."""
    out = {k: [0, 0, 0] for k in TYPES}
    for t, found in zip(texts, pii.find(texts, tagger)):
        want = {(a, b, TYPES[k]) for a, b, k in label(t)}
        got = set(found)
        for k in TYPES:
            out[k][0] += sum(x[2] == k for x in want)
            out[k][1] += sum(x[2] == k for x in got)
            out[k][2] += sum(x[2] == k for x in want & got)
    return {k: tuple(v) for k, v in out.items()}


if __name__ == "__main__":
    import pyarrow.parquet as pq

    rows = [t for t in pq.read_table(sys.argv[1], columns=["text"]).column(0).to_pylist() if t]
    train(rows, int(sys.argv[3]) if len(sys.argv) > 3 else STEPS, 48, workers=int(sys.argv[4]) if len(sys.argv) > 4 else 1, start=Tagger.load(sys.argv[5]) if len(sys.argv) > 5 else None).save(sys.argv[2])
