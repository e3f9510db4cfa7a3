"""Personal information in free text: found by a character tagger, replaced by typed placeholders.

1. The whole text is searched for places where the exact check (3) could let a value through. Each of them, with the context
   beside it, is cut into overlapping windows; what lies outside can't become a row, whatever the tagger says of it.
2. The bidirectional LSTM with CRF transitions (`tagger`) decodes each window.
3. An exact check puts each span on whole tokens and drops what can't be a value of its type.
4. Spans of overlapping windows are reconciled over the whole text: of those in conflict, the set with the greatest
   total score stays.

The candidate search (a sign of an address, seven digits close together, a number beside a street word, two capitalised words) picks the
windows that training draws on. Decoding only where it strikes is left as a quick look on request, which misses values (`full=False`).
"""

from __future__ import annotations

import functools
import io
import itertools
import pkgutil
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rillflow.llm.tagger import TYPES, Tagger, encode
from rillflow.runtime import spread

MODEL = "pii_tagger.npz"
#: Characters of context around a candidate, of a window, and that two windows share.
CONTEXT, WINDOW, OVERLAP, BATCH = 36, 144, 56, 384
#: The same of windows over a whole text: two share so much that any value has some context in one of them.
LONG_WINDOW, LONG_OVERLAP = 640, 112
#: Characters decoded on either side of a possible value: what a value in the middle of two windows' common part has beside it.
BESIDE = LONG_OVERLAP // 2
#: Windows decoded before, by text; only saves time (revisions repeat each other).
REMEMBERED = 100_000
#: Windows looked up at once: bounds what is held beside the texts, however long they are.
ROUND = 8_192

# Words that mark a street, and function words that begin sentences, in the four languages of the corpus.
STREET = "street|road|row|lane|close|cl|st|rd|ln|ave|avenue|blvd|boulevard|drive|court|way|square|terrace|weg|platz|allee|ring|rue|impasse|place|chemin|allée|quai|calle|avenida|plaza|paseo|camino|crescent|gardens|dr|ct|via|piazza|rua|str"
NOT_GIVEN = (
    "the a an in of on at by for from it its he she they between after before when while each every later production according this that these those there as and or but if to with see "
    "der die das ein eine im am als er sie es seit zwischen laut von vom zum zur und wie auf bei für mit nach "
    "le la les un une des du de en au aux il elle on depuis entre et où pour par selon quand sur "
    "el los las una unos del al allí según desde está cuando con por para y cada redirect category file infobox"
).split()

_CAP = r"[A-ZÀ-ÖØ-Þ][^\W\d_]*(?:['’][^\W\d_]+)?"
_NAMES = re.compile(rf"({_CAP})(?:-{_CAP})?(?:,\s|[\s\u00a0]+(?:[A-Z]\.[\s\u00a0]*)?(?:(?:van|von|de|della|al|der|du|la|di|el|bin)[\s\u00a0]+)?)(?=[A-ZÀ-ÖØ-Þ][^\W\d_])")
_AT = re.compile(r"@|[(\[]\s?at\s?[)\]]|&#64;|&commat;|\sat\s[\w-]+\sdot\s", re.I)
_DIGITS = re.compile(r"\d(?:[  .\-/()]{0,2}\d){6,}")
_AT_HINTS = ("@", "at)", "at]", "at )", "at ]", "&#64;", "&commat;", " dot ")
#: A house number before the street, and any number that may be one behind it.
_HOUSE = re.compile(r"\d{1,4}[A-Za-z]?(?:\s(?:bis|ter|BIS|TER))?,?\s(?=[A-ZÀ-Þ#]|impasse|place|rue|avenue|chemin|allée|boulevard|quai)")
_NUMBER = re.compile(r"\d{1,4}(?!\d)")
_STREETS = frozenset(STREET.split("|"))
_STREET_ENDS = ("straße", "strasse", "gasse", "hof", "weg", "platz", "allee", "str")
#: How far from a house number the street word may stand, before and after.
_BEFORE, _AFTER = 32, 40
_DIGIT = re.compile(r"\d")


def _has_street(piece: str) -> bool:
    return any(w in _STREETS or w.endswith(_STREET_ENDS) for w in piece.lower().replace(",", " ").replace(".", " ").replace("/", " ").split()) or "C/" in piece


def candidates(text: str) -> list[tuple[int, int]]:
    """Stretches of the text to decode, merged, in order."""
    low = text.lower()
    spots = [m.span() for m in _AT.finditer(text)] if any(h in low for h in _AT_HINTS) else []
    spots += [m.span() for m in _DIGITS.finditer(text)]
    for m in _HOUSE.finditer(text):
        if _has_street(text[m.end() : m.end() + _AFTER]):
            spots.append((m.start(), min(len(text), m.end() + _AFTER)))
    for m in _NUMBER.finditer(text):
        a = m.start()
        if text[a - 1 : a] != " " or text[a - 2 : a - 1] in ("|", "="):
            continue
        # Four digits after a word in lower case are a year.
        if m.end() - a == 4 and text[text.rfind(" ", max(0, a - _BEFORE), a - 1) + 1].islower():
            continue
        if _has_street(text[max(0, a - _BEFORE) : a]):
            spots.append((max(0, a - _BEFORE), m.end()))
    spots += [m.span() for m in _NAMES.finditer(text) if m.group(1).lower() not in _STOP]
    spots.sort()
    out: list[tuple[int, int]] = []
    for a, b in spots:
        a, b = max(0, a - CONTEXT), min(len(text), b + CONTEXT)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_STOP = frozenset(NOT_GIVEN)


def windows(text: str, full: bool = False, stretches: list[tuple[int, int]] | None = None) -> Iterator[tuple[int, int]]:
    """The stretches (the candidates, with `full` the whole text, unless they are given) cut into overlapping windows."""
    long, shared = (LONG_WINDOW, LONG_OVERLAP) if full else (WINDOW, OVERLAP)
    if stretches is None:
        stretches = [(0, len(text))][: len(text)] if full else candidates(text)
    for a, b in stretches:
        while b - a > long:
            yield a, a + long
            a += long - shared
        yield a, b


def spans_of(tags: np.ndarray, gain: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(start, end, type, score) of the tag path of a window."""
    on = np.flatnonzero(tags)
    out: list[tuple[int, int, int, float]] = []
    for i in on:
        kind, begins = (int(tags[i]) - 1) // 2, tags[i] % 2 == 1
        if not begins and out and out[-1][1] == i and out[-1][2] == kind:
            out[-1] = (out[-1][0], int(i) + 1, kind, out[-1][3] + float(gain[i]))
        else:
            out.append((int(i), int(i) + 1, kind, float(gain[i])))
    return out


def reconcile(spans: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
    """The spans without overlap whose scores sum to the most."""
    best: dict[tuple[int, int, int], float] = {}
    for a, b, k, s in spans:
        best[a, b, k] = max(best.get((a, b, k), 0.0), s)
    items = sorted((b, a, k, s) for (a, b, k), s in best.items() if s > 0)
    if all(x[0] <= y[1] for x, y in zip(items, items[1:])):
        return [(a, b, k) for b, a, k, _ in items]
    import bisect

    ends = [x[0] for x in items]
    total, take = [0.0], []
    for i, (b, a, k, s) in enumerate(items):
        j = bisect.bisect_right(ends, a, 0, i)
        take.append((total[j] + s > total[i], j))
        total.append(max(total[j] + s, total[i]))
    out, i = [], len(items)
    while i:
        used, j = take[i - 1]
        if used:
            b, a, k, _ = items[i - 1]
            out.append((a, b, k))
        i = j if used else i - 1
    return out[::-1]


_AT_FORM = r"(?:\s?@\s?|\s?[(\[]\s?at\s?[)\]]\s?|&#64;|&commat;)"
_DOT_FORM = r"(?:\.|\s?[(\[]\s?dot\s?[)\]]\s?|\sdot\s)"
_EMAIL = re.compile(rf"[\w.+%-]*[\w+]{_AT_FORM}[\w-]+(?:{_DOT_FORM}[\w-]+)+", re.I)
#: A word "at" counts where no sign of an address stands.
_EMAIL_SPOKEN = re.compile(rf"[\w.+%-]*[\w+]\sat\s[\w-]+(?:{_DOT_FORM}[\w-]+)+", re.I)
_PHONE = re.compile(r"(?:\+|\()?\d(?:[  .\-]?[()]?[  .\-]?\d){5,16}(?:\s?(?:ext|x)\.?\s?\d{1,5})?", re.I)
_PHONE_WORD = re.compile(r"(?:tel|phone|call|ring|mobile|fax|text me|telefon|tél|teléfono|reach)\W", re.I)
_ID = re.compile(r"(?<![^\W_])[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D](?![^\W_])|(?<![^\W_])[A-Z]\d\d[A-Z]\d\d[A-Z]\d\d(?![^\W_])|(?:(?<![^\W_])(?:[A-Za-z]{1,2}|[A-Z][ -]))?\d(?:[ .\-]?\d){6,14}(?:-?[A-Za-z](?![^\W_]))?")
_FIRST = re.compile(r"([^\W\d_]+)[\s:,]+(?=[^\W_])")
_PARTICLES = frozenset("van von de della al der du la di el bin".split())
#: Function words that no name begins with, and particles that are no given name with a capital either.
_NO_NAME, _ARTICLES = _STOP - _PARTICLES - {"des", "les"}, _STOP & _PARTICLES - {"al"}
#: Endings of file names, which are no domains.
_FILE = re.compile(r"\.(?:png|jpe?g|gif|svg|webp|tiff?)$", re.I)
_ISBN = re.compile(r"isbn[\s:=]*$", re.I)
_LEAD = re.compile(rf"(?!(?:{STREET}|c|flat|apt|unit|floor|am|im|an|auf|zum|zur)\b|[^\W\d_]*(?:straße|strasse|gasse|hof|weg)\b)[a-zà-ÿ]+[\s:,]+(?=[^\W_])")
_WORD = r"[^\W\d_]+(?:['’][^\W\d_]+)?"
_FULL_NAME = re.compile(rf"{_WORD}(?:-{_WORD})?(?:(?:\s|&nbsp;)+[^\W\d_]\.)*(?:(?:\s|&nbsp;)+(?:van|von|de|della|al|der|du|la|di|el|bin))*(?:\s|&nbsp;)+{_WORD}(?:-{_WORD})?|{_WORD}(?:-{_WORD})?,\s{_WORD}(?:-{_WORD})?(?:\s[^\W\d_]\.)*", re.I)


def check(text: str, a: int, b: int, kind: int) -> tuple[int, int] | None:
    """The span on whole tokens and without outer punctuation, or None where it can't be a value of the type."""
    name = TYPES[kind]
    if name in ("email", "phone", "id_number"):
        lo = max(0, a - 40)
        best, most = None, 0
        for pattern in {"email": (_EMAIL, _EMAIL_SPOKEN), "phone": (_PHONE,), "id_number": (_ID,)}[name]:
            for m in pattern.finditer(text, lo, min(len(text), b + 40)):
                common = min(b, m.end()) - max(a, m.start())
                if common > most and common >= 0.5 * (b - a):
                    best, most = m.span(), common
            if best:
                break
        if best is None:
            return None
        a, b = best
        if name == "email":
            return None if _FILE.search(text, a, b) else (a, b)
        value = re.sub(r"\s?(?:ext|x)\.?\s?\d+$", "", text[a:b], flags=re.I) if name == "phone" else text[a:b]
        digits = len(_DIGIT.findall(value))
        if name == "phone" and text[a] == "(" and ")" not in text[a:b]:
            a += 1
        if name == "phone" and text[a:b].isdigit() and text[a] != "0" and not _PHONE_WORD.search(text, max(0, a - 24), a):
            return None  # a bare number says no more than its digits
        if _ISBN.search(text, max(0, a - 8), a):
            return None
        return (a, b) if (6 if text[a:b][:1].isalpha() else 7) <= digits <= 15 else None
    word = lambda c: c.isalnum()
    while a > 0 and word(text[a - 1]) and word(text[a]):
        a -= 1
    while b < len(text) and word(text[b - 1]) and word(text[b]):
        b += 1
    lead, tail = (" \n\t.,;:|*'\"“”()[]{}<>=–-#!/&", " \n\t,;:|*'\"“”()[]{}<>=–-#!/&.")
    while a < b and text[a] in lead:
        a += 1
    while a < b and text[b - 1] in tail:
        b -= 1
    if name == "name":
        # Words of the sentence before the name.
        while (m := _FIRST.match(text, a, b)) and m.group(1).lower() in _NO_NAME:
            a = m.end()
        words = [w for w in re.findall(_WORD, text[a:b]) if w not in _PARTICLES and w.lower() not in _ARTICLES and w != "nbsp"]
        good = len(words) > 1 and all(w[0].isupper() for w in words) and words[-1].lower() not in _STREETS and _FULL_NAME.fullmatch(text, a, b)
        return (a, b) if good else None
    if text[b : b + 1] == "." and re.search(r"\b(?:Ave|Rd|St|Blvd|Ln)$", text[a:b], re.I) and not re.search(r"\d$", text[a:b]):
        b += 1
    # Words of the sentence before the address.
    while (m := _LEAD.match(text, a, b)) or ((m := _FIRST.match(text, a, b)) and m.group(1).lower() in _STOP - {"am"}):
        a = m.end()
    piece = text[a:b]
    return (a, b) if _DIGIT.search(piece) and _has_street(piece) and "\n" not in piece else None


# What any value that `check` lets through must have in it. These patterns take in more than those of the check, never less.
#: Any capital letter, and all that lies beyond Latin-1.
_CAPITAL = r"[A-ZÀ-ÖØ-Þ\u0100-\U0010ffff]"
_KEPT = rf"{_CAPITAL}(?<![^\W_].)[^\W\d_]*+(?:['’][^\W\d_]++){{0,8}}+"
#: Words that don't count in a name, and what else stands between two that do: a stop behind one letter, a hyphen between two.
_UNCOUNTED = rf"(?:nbsp|{'|'.join(sorted(_PARTICLES))}|(?i:{'|'.join(sorted(_ARTICLES))}))(?!['’]?[^\W\d_])"
_JOINT = rf"(?:\s++|,(?=\s)|(?<=[^\W\d_])(?<![^\W\d_][^\W\d_])\.|(?<=[^\W\d_])-(?=[^\W\d_])|&nbsp;|&(?=(?i:nbsp);)|(?<=(?i:nbsp));|{_UNCOUNTED})"
# Further apart than a window is long, or behind more joined parts, two words are in no name: so the search takes no more than some time a character.
_CHAIN = re.compile(rf"{_KEPT}(?:{_JOINT}{{1,{LONG_WINDOW}}}+{_KEPT})++")
_KEPT_WORD = re.compile(rf"({_KEPT}){_JOINT}*+")
_UNCOUNTED_BEFORE = re.compile(rf"(?<![^\W\d_]){_UNCOUNTED}(?:\W|nbsp;)+\Z")
_SIX_DIGITS = re.compile(r"\d(?:[\s.\-()]{0,3}+[A-Z]?+\d){5,}+")
_DOMAIN = rf"[\w-]++(?:(?i:{_DOT_FORM})[\w-]++)+"
_SOME_AT, _SOME_SIGN = re.compile(rf"[Aa][Tt](?=((?:\s?[)\]]\s?|\s){_DOMAIN}))"), re.compile(rf"(?:@|&#64;|&(?i:commat);)(?=(\s?{_DOMAIN}))")
_MAILBOX = re.compile(r"[\s(\[]*+[\w.+%-]*+")
_TO_DIGIT = re.compile(r"[^\d\n]*+\d")


def _tree(words: Iterable[str]) -> str:
    """A pattern of any of the words, by their first letters: the search then passes over most of a text at once."""
    by_first: dict[str, list[str]] = {}
    for w in words:
        by_first.setdefault(w[:1], []).append(w[1:])
    ends = by_first.pop("", None)
    if not by_first:
        return ""
    heads = [c + _tree(rest) for c, rest in by_first.items()]
    return f"(?:{'|'.join(heads)}){'?' if ends else ''}"


_STREET_WORD, _STREET_END = (re.compile(rf"{_tree(sorted(words))}(?![^\W_])") for words in (_STREETS, _STREET_ENDS))
_SHORT_STREET = re.compile("c/")


def possible(text: str) -> list[tuple[int, int]]:
    """Stretches, merged and in order, of all places where `check` could let a value through, each with the context beside it. Of
    values longer than a window only parts may lie in them."""
    spots = [m.span() for m in _SIX_DIGITS.finditer(text)]
    for pattern in (_SOME_AT, _SOME_SIGN) if "@" in text or "&" in text else (_SOME_AT,):
        for m in pattern.finditer(text):
            a = m.start()
            spots.append((a - _MAILBOX.match(text[max(0, a - LONG_WINDOW) : a][::-1]).end(), m.end(1)))
    for m in _CHAIN.finditer(text):
        a, b = m.span()
        words = _KEPT_WORD.findall(text, a, b)
        n = len(words)
        # Function words before a name are taken off it; what then is left needs two words, the last of them no street.
        if words[0].lower() in _NO_NAME and not _UNCOUNTED_BEFORE.search(text, max(0, a - 40), a):
            while n and (m := _FIRST.match(text, a, b)) and m.group(1).lower() in _NO_NAME:
                a, n = m.end(), n - 1
        if n > 2 or n == 2 and words[-1].lower() not in _STREETS:
            spots.append((a, b))
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower()[0] for c in text)
    streets = [m.span() for m in _STREET_WORD.finditer(low) if not low[m.start() - 1 : m.start()].isalnum()] + [m.span() for p in (_STREET_END, _SHORT_STREET) for m in p.finditer(low)]
    for a, b in streets:
        before, after = _TO_DIGIT.match(text[max(0, a - LONG_WINDOW) : a][::-1]), _TO_DIGIT.match(text, b, b + LONG_WINDOW)
        if before or after:
            spots.append((a - before.end() if before else a, after.end() if after else b))
    spots.sort()
    out: list[tuple[int, int]] = []
    for a, b in spots:
        a, b = max(0, a - BESIDE), min(len(text), b + BESIDE)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


@functools.lru_cache(maxsize=1)
def model(name: str = MODEL) -> Tagger:
    """The trained tagger beside this module, which may lie in an archive."""
    return Tagger.load(io.BytesIO(pkgutil.get_data(__package__, name)))


def _places(text: str, known: dict, full: bool) -> Iterator[tuple[int, int]]:
    """Windows to decode; a text of which all windows are known isn't searched for places again."""
    if full and any(text[a:b] not in known for a, b in windows(text, True)):
        return windows(text, True, possible(text))
    return windows(text, full)


def find(texts: list[str], tagger: Tagger | None = None, known: dict | None = None, full: bool = True) -> list[list[tuple[int, int, str]]]:
    """Spans (start, end, type) of each text, in order; offsets are code points of the text as it is.

    full: decode the whole of every text, but for what `check` would refuse whatever the tagger says. Without it only the candidate places
    are: less work, but values of forms that no candidate pattern looks for are missed."""
    tagger = tagger or model()
    known = {} if known is None else known
    spans: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
    places = ((i, a, b) for i, t in enumerate(texts) for a, b in _places(t, known, full))
    while part := list(itertools.islice(places, ROUND)):
        todo = {texts[i][a:b] for i, a, b in part} - known.keys()
        ordered = sorted(todo, key=len)
        for k in range(0, len(ordered), BATCH):
            pieces = ordered[k : k + BATCH]
            for piece, (tags, gain) in zip(pieces, tagger.decode([encode(p) for p in pieces])):
                known[piece] = spans_of(tags, gain)
        for i, a, b in part:
            t = texts[i]
            for s, e, k, score in known[t[a:b]]:
                cut = (s == 0 and a > 0) or (e == b - a and b < len(t))
                if fixed := check(t, a + s, a + e, k):
                    # On the best path a span may owe its place to the transitions: it counts, but loses to any other.
                    spans[i].append((*fixed, k, max(score, 1e-3) * (0.5 if cut else 1.0)))
        if len(known) > REMEMBERED:
            known.clear()
    return [[(a, b, TYPES[k]) for a, b, k in reconcile(found)] for found in spans]


def find_pii(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", full: bool = True) -> DataFrame:
    """One row an occurrence: (id, span_start, span_end, pii_type); offsets are 0-based code points, the end exclusive.

    Null and empty texts have no rows. A text stored twice under one id gives its rows once for each. All of a text is decoded that
    may become a row, window by window; `full` as in `find`. Nothing is shuffled (but small inputs are spread over the cores); the tagger (about 70 KB) is read once a worker.
    """
    out = T.StructType([T.StructField(id_column, df.schema[id_column].dataType), T.StructField("span_start", T.LongType()), T.StructField("span_end", T.LongType()), T.StructField("pii_type", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            rows, starts, ends, kinds = [], [], [], []
            for i, spans in enumerate(find(texts, known=known, full=full)):
                for s, e, k in spans:
                    rows.append(i)
                    starts.append(s)
                    ends.append(e)
                    kinds.append(k)
            if rows:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(kinds)], names=out.names)

    return spread(df.select(id_column, text_column)).where(f"`{text_column}` <> ''").mapInArrow(run, out)


def placeholder(kind: str) -> str:
    return f"[{kind.upper()}]"


def mask(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """The text with each span replaced by its placeholder, the rest unchanged."""
    if not text or not spans:
        return text
    out, at = [], 0
    for s, e, k in spans:
        out += [text[at:s], placeholder(k)]
        at = e
    return "".join([*out, text[at:]])


def redact(df: DataFrame, text_column: str = "text", full: bool = True) -> DataFrame:
    """The input with personal information in the text replaced; all other columns and rows as they are. Nulls stay null."""
    schema, place = df.schema, df.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for b in batches:
            texts = b.column(place).to_pylist()
            done = [mask(t, s) for t, s in zip(texts, find([t or "" for t in texts], known=known, full=full))]
            columns = [pa.array(done, b.schema.field(i).type) if i == place else b.column(i) for i in range(b.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return spread(df).mapInArrow(run, schema)
