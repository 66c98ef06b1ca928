"""Sentence boundaries: characters classed by compiled rules, then a finite transducer whose runs compose by prefix scan."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brookmill.session import SharedTable

# ---- fixed values: words whose period ends nothing, by language
NEVER = frozenset(
    # English: titles, references, measures
    "mr mrs ms dr prof st nos fig figs tab sec eq vol ch approx vs cf al temp est dept gen col sgt capt lt cmdr maj adm hon rev gov sen rep mt ft resp incl excl max min avg pp ed eds viz esp ph messrs mx supt insp cpl pvt ave blvd rd assn bros univ "
    # German
    "nr abb vgl ca bzw evtl ggf inkl zzgl str hr fr bspw sog geb tel jh jhd mind allg mio mrd tsd med phil rer nat jur ing habil dipl theol hrsg bd aufl verf bes entspr gem lt zz sog sogen einschl ausschl durchschn ehem "
    # French
    "env ex mme mlle mlles mmes art chap ch boul av pr vve fig réf éd "
    # Spanish
    "pág págs aprox ej sr sra srta sres dra ud uds vd vds núm cap lic ing arq depto avda dcha izda "
    # Russian
    "рис см т.е ср напр им ул стр гл табл тел просп пер корп обл проф акад доц "
    # Arabic and Hindi
    "د أ م ص डॉ श्री कु सं प्रो".split()
)
#: Words among them that are units after a number, and then may end a sentence.
UNITS = frozenset("min sec ft см стр h".split())
#: Words whose period may also end a sentence: it does if what follows looks like a start.
EITHER = frozenset("a.m p.m etc usw inc ltd co corp jr u.s u.k u.n e.u т.д т.п т.к др usf ff ph.d m.d b.sc m.sc b.a m.a llc plc мин сек тыс млн млрд руб коп".split())
#: Those of them that mostly end one: they do where a text has no capitals to tell by.
LAST = frozenset("etc usw т.д т.п др usf".split())
#: Those of them that often stand before a name: only a word that sentences commonly start with makes them an end.
BEFORE_NAMES = frozenset("u.s u.k u.n e.u".split())
STARTERS = frozenset("the a an it he she they we you i this that these those there here in on at by for from with as if when while after before but and so then its his her their our no not however what why how who".split())
#: Short names of months, and words that number what follows: no end before a number, else as EITHER.
BEFORE_NUMBERS = frozenset(
    "jan feb apr jun jul aug sep sept oct okt nov dec dez mär janv févr avr juil déc ene abr dic янв фев февр апр авг сент окт нояб дек".split())
#: Words of their own that also number what follows: no end before a number, else one.
NUMBERS = frozenset("no mar op".split())
#: Cyrillic letters that stand for a word (town, house, street, page, century) unless a number comes before.
LETTERS = frozenset("гдосрптмчвк")
#: Words before a day or a count in German, after which a number's period makes it an ordinal.
ORDINAL = frozenset("am im der den dem des vom zum zur beim die das ab bis seit jeden jedem ein einen einem nach vor".split())

# ---- symbols of the transducer; SOFT is a period that ends a sentence if a start follows, CASELESS a letter without case that begins a word
OTHER, UPPER, TERM, CLOSE, OPEN_QUOTE, OPEN_BRACKET, SPACE, BREAK, TRAIL, SOFT, CASELESS = range(11)
N_SYMBOLS = 11
# ---- its states: nothing yet; in a sentence; after its end mark; inside a quotation or a bracket, and there after an end
# mark; the same for a bracket that began the sentence; after a quotation that held an end mark, and after blanks there;
# after a period that may be an end
IDLE, TEXT, ENDED, INSIDE, INSIDE_ENDED, ALONE, ALONE_ENDED, AFTER, AFTER_SPACE, MAYBE = range(10)
N_STATES = 10


def _row(other: tuple, term: tuple, close: tuple, quote: tuple, bracket: tuple, space: tuple, trail: tuple, upper: tuple | None = None, soft: tuple | None = None, caseless: tuple | None = None) -> dict[int, tuple[int, bool]]:
    return {OTHER: other, UPPER: upper or other, TERM: term, CLOSE: close, OPEN_QUOTE: quote, OPEN_BRACKET: bracket, SPACE: space, BREAK: (IDLE, True), TRAIL: trail, SOFT: soft or term, CASELESS: caseless or other}


def _go(state: int, ends: bool = False) -> tuple[int, bool]:
    return state, ends


#: (state, symbol) -> (next state, whether a sentence ends before this character)
_RULES: dict[int, dict[int, tuple[int, bool]]] = {
    IDLE: _row(_go(TEXT), _go(TEXT), _go(TEXT), _go(INSIDE), _go(ALONE), _go(IDLE), _go(TEXT)) | {BREAK: _go(IDLE)},
    TEXT: _row(_go(TEXT), _go(ENDED), _go(TEXT), _go(INSIDE), _go(INSIDE), _go(TEXT), _go(TEXT), soft=_go(MAYBE)),
    ENDED: _row(_go(TEXT, True), _go(ENDED), _go(ENDED), _go(INSIDE, True), _go(ALONE, True), _go(IDLE, True), _go(ENDED)),
    INSIDE: _row(_go(INSIDE), _go(INSIDE_ENDED), _go(TEXT), _go(INSIDE), _go(INSIDE), _go(INSIDE), _go(INSIDE)),
    INSIDE_ENDED: _row(_go(INSIDE), _go(INSIDE_ENDED), _go(AFTER), _go(INSIDE), _go(INSIDE), _go(INSIDE_ENDED), _go(INSIDE_ENDED)),
    ALONE: _row(_go(ALONE), _go(ALONE_ENDED), _go(TEXT), _go(ALONE), _go(ALONE), _go(ALONE), _go(ALONE)),
    ALONE_ENDED: _row(_go(ALONE), _go(ALONE_ENDED), _go(ENDED), _go(ALONE), _go(ALONE), _go(ALONE_ENDED), _go(ALONE_ENDED)),
    AFTER: _row(_go(TEXT), _go(ENDED), _go(AFTER), _go(INSIDE, True), _go(INSIDE), _go(AFTER_SPACE), _go(AFTER)),
    AFTER_SPACE: _row(_go(TEXT), _go(ENDED), _go(AFTER), _go(INSIDE, True), _go(INSIDE), _go(AFTER_SPACE), _go(AFTER_SPACE), upper=_go(TEXT, True)),
    MAYBE: _row(_go(TEXT), _go(ENDED), _go(MAYBE), _go(INSIDE, True), _go(ALONE, True), _go(MAYBE), _go(MAYBE), upper=_go(TEXT, True), soft=_go(MAYBE), caseless=_go(TEXT, True)),
}
_NEXT = np.array([[_RULES[q][s][0] for s in range(N_SYMBOLS)] for q in range(N_STATES)], dtype=np.uint8).ravel()
_ENDS = np.array([[_RULES[q][s][1] for s in range(N_SYMBOLS)] for q in range(N_STATES)], dtype=bool).ravel()
CHUNK = 256

# ---- compiled rules that give a text's characters their symbols
_MARK = re.compile(r"[.!?。！？｡．।॥؟۔…‥]+")
_PARAGRAPH = re.compile(r"\n[^\S\n]*(?:>[^\S\n]*)*\n[\s>]*")
_QUOTED_LINE = re.compile(r"^[^\S\n]*(?:>[^\S\n]?)+", re.M)
_LIST = re.compile(r"\n[^\S\n]*(?:>[^\S\n]?)*(?=(?:[-*•·–]|([0-9]{1,3})[.)]|[A-Za-z][)]|\([A-Za-z0-9]{1,3}\))[^\S\n]+\S)")
_NUMBERED = re.compile(r"^[^\S\n]*(?:>[^\S\n]?)*([0-9]{1,3}(?:\.[0-9]{1,3})*)\.(?=\s)", re.M)
_STOPS = frozenset("\"“”„«»‚‘()[]{}<>*_…,;:—–/")
_CAMEL = re.compile(r"[a-z]+[A-Z]")
#: Starts of sentences without a capital: Latin abbreviations and names in camel case.
_EG = re.compile(r"e\.g\.|i\.e\.|[a-z]+[A-Z]")
_NEXT_WORD = re.compile(r"[\s*_]*([^\W_]*)")
_THAI_GAP = re.compile(r"(?<![0-9๐-๙\s])\s+(?![0-9๐-๙\s])")
_QUOTES = {"“": "”", "«": "»", "「": "」", "『": "』", "„": "“", "（": "）", "(": ")", "[": "]", "【": "】", "《": "》", "‹": "›"}
_BRACKETS = frozenset("（([【")
_PAIRED = re.compile(r"[“”„«»「」『』（）()\[\]【】《》‹›\"]")
_TRAILS = frozenset("\"'”’“»)]」』）】》›*_")


def _one_case(text: str) -> str:
    """``upper`` or ``lower`` for a text in one case, whose letters tell no starts; else nothing."""
    if text.lower() == text.upper():
        return ""
    return "upper" if text.upper() == text else "lower" if text.lower() == text else ""


def _pairs(text: str, low: int, high: int) -> list[tuple[int, int]]:
    """The outermost matched quotations and brackets of a paragraph. Marks without a partner there are ordinary."""
    stack: list[tuple[str, int]] = []
    found: list[tuple[int, int]] = []
    straight = text.count('"', low, high) % 2 == 0
    for m in _PAIRED.finditer(text, low, high):
        c, at = m[0], m.start()
        close = None
        if c == '"':
            if not straight:
                continue
            close = any(o == '"' for o, _ in stack)
            if not close:
                stack.append((c, at))
                continue
        elif c == "“" and any(o == "„" for o, _ in stack):
            close = True
        elif c in _QUOTES:
            if c == "(" and at + 1 < high and text[at + 1] == ")":
                continue
            stack.append((c, at))
            continue
        for k in range(len(stack) - 1, -1, -1):
            if (stack[k][0] == '"') if c == '"' else _QUOTES.get(stack[k][0]) == c:
                found.append((stack[k][1], at))
                del stack[k:]
                break
    outer: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if not outer or a > outer[-1][1]:
            outer.append((a, b))
    return outer


def _classes() -> tuple[np.ndarray, ...]:
    """For each code point of the basic plane, and one place for all others: whether it is a blank, a capital, a letter without case, alphanumeric, or ends a word before a period."""
    chars = [chr(c) for c in range(0x10000)]
    blank = [c.isspace() or 0x2000 <= ord(c) <= 0x200D or c == "\ufeff" for c in chars]
    table = [blank, [c.isupper() for c in chars], [c.isalpha() and c.lower() == c.upper() for c in chars], [c.isalnum() for c in chars], [c.isspace() or c in _STOPS for c in chars]]
    return tuple(np.array([*x, False]) for x in table)


_BLANK, _UPPER, _CASELESS, _ALNUM, _STOP = _classes()


class _Periods:
    """Decides on the single periods of one paragraph, from left to right; words are never cut and never read twice."""

    def __init__(self, text: str, low: int, high: int, stop: np.ndarray, blank: np.ndarray, line_numbers: set[int], case: str):
        self.text, self.low, self.high, self.line_numbers, self.case = text, low, high, line_numbers, case
        place = np.arange(low, high)
        self.stop = np.maximum.accumulate(np.where(stop[low:high], place, low - 1))
        self.blank = np.maximum.accumulate(np.where(blank[low:high], place, low - 1))
        self.solid = np.maximum.accumulate(np.where(blank[low:high], low - 1, place))
        self.word, self.dot, self.dotted = -1, -1, False

    def before(self, at: int, last: np.ndarray) -> int:
        return int(last[at - 1 - self.low]) if at > self.low else self.low - 1

    def symbol(self, at: int) -> int | None:
        """TERM, SOFT or None for the period at ``at``."""
        text = self.text
        start = self.before(at, self.stop) + 1
        # single letters with periods between them, as far as this word goes
        if start != self.word:
            self.word, self.dotted = start, at - start == 1 and text[start].isalpha()
        else:
            self.dotted = self.dotted and at - self.dot == 2 and text[at - 1].isalpha()
        part = start if self.dot < start else self.dot + 1
        letters, self.dot = self.dotted and part > start, at
        if at in self.line_numbers:
            return None
        whole = text[start:at].lower().replace("\xad", "") if at - start <= 24 else ""
        if letters or whole in NEVER or whole in EITHER:
            word = whole or "a.a"  # a longer one is in no list
        else:
            word = text[part:at].lower().replace("\xad", "") if at - part <= 24 else text[at - 1]
        single = len(word) == 1 and at - part == 1
        after = text[at + 1 : at + 2]
        if after and not after.isspace() and after not in _TRAILS:
            return TERM if self._glued(at, word, after, letters) else None
        if at == start:
            return TERM
        # what comes before a word that a missing space glued to another one is that one
        glued = part > start and not letters and not (whole in NEVER or whole in EITHER)
        end = part - 1 if glued else self.before(start, self.solid)
        size = end - self.before(end + 1, self.blank) if end >= self.low else 0
        previous = text[end - min(size, 16) + 1 : end + 1] if size else ""
        numbered = previous[-1:].isdigit()
        if word in NEVER:
            return (TERM if word in UNITS and numbered else None) if not (word in LETTERS and numbered) else TERM
        if word in BEFORE_NUMBERS or word in NUMBERS:
            following = _NEXT_WORD.match(text, at + 1, self.high)[1]
            return None if following[:1].isdigit() else SOFT if word in BEFORE_NUMBERS else TERM
        if word in EITHER:
            return self._either(at, word)
        if letters:
            return None
        if single and word.isalpha():
            return self._letter(at, word, start, previous if size <= 16 else "", numbered)
        if word.isdigit() and len(word) <= 2 and size <= 16 and previous.lower() in ORDINAL:
            return None
        return TERM

    def _either(self, at: int, word: str) -> int | None:
        if self.case and word in LAST:
            return TERM
        if word in BEFORE_NAMES and _NEXT_WORD.match(self.text, at + 1, self.high)[1].lower() not in STARTERS:
            return None if self.text[at + 1 : self.high].strip() else TERM
        return SOFT

    def _glued(self, at: int, word: str, after: str, letters: bool) -> bool:
        """No space follows: a capital that begins a word, after a small letter or a digit."""
        text = self.text
        if at == self.word or word in NEVER or after.isalnum() and not (after.isupper() or _CAMEL.match(text, at + 1)):
            if not (word and word[-1].isalnum() and text.startswith(("e.g. ", "i.e. "), at + 1) and len(word) > 1):
                return False
        if not (after.isalpha() or after in "\"“„«¿¡(["):
            return False
        before = text[at - 1]
        if not (before.islower() or before.isdigit()) or self.case == "upper":
            return False
        following = text[at + 2 : at + 3]
        if after.isupper() and following and not (following.islower() or following in " .'’"):
            return False
        if letters and word not in EITHER:
            return False
        return word not in NEVER and word not in BEFORE_NAMES

    def _letter(self, at: int, word: str, start: int, previous: str, numbered: bool) -> int | None:
        text = self.text
        if start > self.low and text[start - 1] in "/·⋅²³°":
            return TERM  # the last part of a unit such as km/h
        if numbered:
            return TERM  # a unit
        if len(previous) == 2 and previous[0].isalpha() and previous[1] == ".":
            pair = previous[0].lower() + "." + word
            return self._either(at, pair) if pair in EITHER else None  # or the second part of an abbreviation in two
        if previous.lower() == "ph.":
            return SOFT
        nxt = text[at + 1 : at + 5].lstrip()
        if len(nxt) > 1 and nxt[0].isalpha() and nxt[1:2] == ".":
            return None  # the first part
        if word.upper() == word.lower():
            return TERM
        if text[at - 1].isupper() or word in LETTERS:
            return None  # an initial, or a letter that stands for a word
        if word in "pzduтoij":
            return None if re.match(r"\s+[^\W\d_]{1,3}\.", text[at + 1 : at + 8]) else TERM
        return TERM


def _mark_start(text: str, body: np.ndarray, at: int, high: int) -> None:
    """Makes the next word's first letter a capital to the transducer if sentences start with such a word without one."""
    while at < high and text[at].isspace():
        at += 1
    if at < high and body[at] == OTHER and text[at].islower() and _EG.match(text, at):
        body[at] = UPPER


def symbols(text: str) -> np.ndarray:
    """The transducer's symbol of every character of ``text``, and a BREAK after the last one."""
    code = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), 0x10000)
    out = np.zeros(len(code) + 1, dtype=np.uint8)
    body = out[:-1]
    blank, stop, alnum = _BLANK[code], _STOP[code], _ALNUM[code]
    first = np.ones(len(code), dtype=bool)
    first[1:] = ~alnum[:-1]
    body[first & _CASELESS[code]] = CASELESS
    body[first & _UPPER[code]] = UPPER
    body[(code == 0xBF) | (code == 0xA1)] = CASELESS
    body[(code == 42)] = TRAIL
    body[blank | (code <= 32)] = SPACE
    breaks = [(m.start(), m.end()) for m in _PARAGRAPH.finditer(text)]
    spans, low = [], 0
    for a, b in breaks:
        spans.append((low, a))
        low = b
        body[a:b] = SPACE
        body[a] = BREAK
    spans.append((low, len(text)))
    if ">" in text:
        for m in _QUOTED_LINE.finditer(text):
            body[m.start() : m.end()] = SPACE
    numbers = {m.end() - 1 for m in _NUMBERED.finditer(text)} if "." in text else set()
    for low, high in spans:
        if low >= high:
            continue
        case = _one_case(text[low:high])
        if case == "upper":
            body[low:high][body[low:high] == UPPER] = OTHER
        # list entries begin sentences; a number counts if it begins or continues a list
        last, starts, line_numbers = 0, [], set()
        head = _NUMBERED.match(text, low, high)
        if head and head.start() == low:
            line_numbers.add(head.end() - 1)
            last = int(head[1].split(".")[0])
        for m in _LIST.finditer(text, low, high):
            if m[1]:
                before = text[max(low, m.start() - 3) : m.start()].rstrip()[-1:]
                ends = before in ".!?:;。！？।؟)" or bool(starts)
                if int(m[1]) != last + 1 or last == 0 and not ends:
                    continue
                last = int(m[1])
                dot = text.find(".", m.end(), m.end() + 5)
                if dot in numbers:
                    line_numbers.add(dot)
            starts.append(m.start())
            body[m.start()] = BREAK
        marks, periods = [], None
        for m in _MARK.finditer(text, low, high):
            s, a, b = m[0], m.start(), m.end()
            if any(c in "!?。！？｡．।॥؟۔" for c in s):
                nxt = text[b : b + 1]
                if s[-1] in "!?" and nxt.isascii() and (nxt.islower() or nxt.isdigit() or nxt in "=&/") and nxt:
                    continue
                marks.append((a, b, TERM))
            elif s == ".":
                periods = periods or _Periods(text, low, high, stop, blank, line_numbers, case)
                kind = periods.symbol(a)
                if kind is not None:
                    marks.append((a, b, kind))
        if not marks:
            part = text[low:high]
            thai = sum(1 for c in part if "฀" <= c <= "๿")
            if thai * 2 > sum(1 for c in part if c.isalpha()):
                for m in _THAI_GAP.finditer(text, low, high):
                    body[m.start()] = BREAK
            else:
                lines = np.flatnonzero(code[low:high] == 10) + low
                body[lines] = BREAK
            continue
        pairs = _pairs(text, low, high)
        for a, b in pairs:
            body[a] = OPEN_BRACKET if text[a] in _BRACKETS else OPEN_QUOTE
            body[b] = CLOSE
        paired = {x for p in pairs for x in p}
        for a, b, kind in marks:
            body[a:b] = kind
            k = b
            while k < high and text[k] in _TRAILS and k not in paired:
                if text[k] == '"' and text[k + 1 : k + 2].isalnum():
                    break
                body[k] = TRAIL
                k += 1
            if kind == SOFT:
                _mark_start(text, body, k, high)
        for _, b in pairs:
            _mark_start(text, body, b + 1, high)
    out[-1] = BREAK
    return out


def run(symbol_rows: list[np.ndarray]) -> list[np.ndarray]:
    """For each text the places before which a sentence ends, by running all texts' chunks side by side.

    A chunk of CHUNK characters is a function from states to states. All chunks of all texts are followed in lockstep
    from every state at once; then functions are composed within each text by a parallel prefix scan (doubling), which
    gives every chunk its first state, and one more pass tells the ends. A long text is only many chunks.
    """
    n_chunks = np.array([-(-len(s) // CHUNK) for s in symbol_rows])
    total = int(n_chunks.sum())
    if not total:
        return [np.zeros(0, dtype=int) for _ in symbol_rows]
    grid = np.full((total, CHUNK), SPACE, dtype=np.uint8)
    first = np.cumsum(n_chunks) - n_chunks
    for s, f in zip(symbol_rows, first):
        grid.reshape(-1)[f * CHUNK : f * CHUNK + len(s)] = s
    steps = np.ascontiguousarray(grid.T)
    many = np.flatnonzero(np.repeat(n_chunks, n_chunks) > 1)
    begin = np.zeros(total, dtype=np.uint8)
    if len(many):
        state = np.broadcast_to(np.arange(N_STATES, dtype=np.uint8), (len(many), N_STATES)).copy()
        for row in steps[:, many]:
            state = _NEXT[state * N_SYMBOLS + row[:, None]]
        place = (np.arange(total) - np.repeat(first, n_chunks))[many]
        scan, hop = state, 1
        while hop <= place.max():
            # a row stands for the last ``hop`` chunks, or for all so far; two of them in a row make one twice as long
            able = np.flatnonzero(place >= hop)
            longer = scan.copy()
            longer[able] = np.take_along_axis(scan[able], scan[able - hop].astype(np.intp), axis=1)
            scan, hop = longer, hop * 2
        follow = np.flatnonzero(place >= 1)
        begin[many[follow]] = scan[follow - 1, IDLE]
    state, ends = begin, np.zeros((CHUNK, total), dtype=bool)
    for k, row in enumerate(steps):
        at = state * N_SYMBOLS + row
        ends[k] = _ENDS[at]
        state = _NEXT[at]
    flat = np.flatnonzero(ends.T.reshape(-1))
    low, high = np.searchsorted(flat, first * CHUNK), np.searchsorted(flat, (first + n_chunks) * CHUNK)
    return [flat[a:b] - f * CHUNK for a, b, f in zip(low, high, first)]


def spans(texts: list[str | None]) -> list[list[tuple[int, int]]]:
    """For each text (start, end) of its sentences: of the first character that is no blank or quoting mark, and after the last one."""
    rows = [symbols(t) if t and not t.isspace() else np.zeros(0, dtype=np.uint8) for t in texts]
    found = []
    for s, ends in zip(rows, run(rows)):
        solid = np.flatnonzero((s != SPACE) & (s != BREAK))
        part, low = [], 0
        for k in np.searchsorted(solid, ends).tolist():
            if k > low:
                part.append((int(solid[low]), int(solid[k - 1]) + 1))
                low = k
        found.append(part)
    return found


def boundaries(texts: list[str | None]) -> list[list[int]]:
    """For each text the ends of its sentences, as numbers of characters up to and including the last one."""
    return [[e for _, e in x] for x in spans(texts)]


#: Texts of more characters than this are cut at blank lines into parts of about as many, which go to any task.
LONG = 1 << 20
_BLANK_LINE = re.compile(r"\n[^\S\n]*(?:>[^\S\n]*)*\n")
SENTENCES = "doc_id bigint, position int, start_pos bigint, end_pos bigint, sentence string"


def long_parts(text: str, size: int = LONG) -> list[tuple[int, int]]:
    """(from, to) of the parts of a long text: each ends with a blank line or the text. Every state goes to IDLE there."""
    found, low = [], 0
    for m in _BLANK_LINE.finditer(text):
        if m.end() - low >= size:
            found.append((low, m.end()))
            low = m.end()
    return [*found, (low, len(text))] if low < len(text) else found


def sentences_of(texts: list[str | None]) -> Iterator[list[tuple[int, int, int, str]]]:
    """For each text (position, start, end, sentence) in order."""
    for t, found in zip(texts, spans(texts)):
        yield [(n, a, b, t[a:b]) for n, (a, b) in enumerate(found)]


def split_sentences(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", long: int = LONG) -> DataFrame:
    """(doc_id, position, start_pos, end_pos, sentence): one row per sentence of every text, in order from 0.

    ``end_pos`` counts code points from the start of the text up to and including the sentence's last character;
    a sentence begins after the quoting marks of its line. Null, empty and blank texts have none. Rules need no language: scripts and words decide, so missing or wrong
    labels don't matter. Texts are cut where they are read, without a shuffle; those of more than ``long`` characters
    are cut at blank lines into rows that any task can take, and a part's sentences are numbered on from how many the
    parts before it have.
    """
    rows = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("position", pa.int32()), ("start_pos", pa.int64()), ("end_pos", pa.int64()), ("sentence", pa.string())])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) or [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                yield batch_of([(i, *x) for i, found in zip(ids, sentences_of(texts)) for x in found])

    short = rows.where(F.length("text") <= long).mapInArrow(cut, SENTENCES)
    size = F.length("text")
    n_long = rows.where(size > long).select(F.lit(1)).limit(1).count()
    if not n_long:
        return short

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, (i, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                found = long_parts(t, long)
                key = uuid.uuid4().hex
                for n, (a, b) in enumerate(found):
                    yield pa.RecordBatch.from_pydict({"doc": [key], "doc_id": pa.array([i], pa.int64()), "part": pa.array([n], pa.int32()), "low": pa.array([a], pa.int64()), "text": [t[a:b]]})

    pieces = SharedTable(rows.where(size > long).mapInArrow(parts, "doc string, doc_id bigint, part int, low bigint, text string"), "parts").read()

    def cut_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, i, n, low, t in zip(*(c.to_pylist() for c in batch.columns)):
                found = next(sentences_of([t]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v] * len(found), kind) for v, kind in ((doc, pa.string()), (i, pa.int64()), (n, pa.int32()))]
                    + [pa.array([x[0] for x in found], pa.int32()), pa.array([low + x[1] for x in found], pa.int64()), pa.array([low + x[2] for x in found], pa.int64()), pa.array([x[3] for x in found], pa.string())],
                    names=["doc", "doc_id", "part", "at", "start_pos", "end_pos", "sentence"])

    spread = pieces.repartition(documents.sparkSession.sparkContext.defaultParallelism * 4, "doc", "part")
    done = SharedTable(spread.mapInArrow(cut_parts, "doc string, doc_id bigint, part int, at int, start_pos bigint, end_pos bigint, sentence string"), "cut").read()
    counts = done.groupBy("doc", "part").agg(F.count("*").alias("n"))
    before = counts.select("doc", "part", F.coalesce(F.sum("n").over(W.partitionBy("doc").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("int").alias("before"))
    placed = done.join(before, ["doc", "part"]).select("doc_id", (F.col("before") + F.col("at")).alias("position"), "start_pos", "end_pos", "sentence")
    return short.unionByName(placed)
