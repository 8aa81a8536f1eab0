"""Problem 2: sentence boundaries in many languages and scripts, by a pushdown automaton.

The automaton reads the signs of a text once. Its stack holds the open quotations and brackets and the levels of lists: a
new item pops what the items at its level and below left open, a blank line empties the stack. At an end mark it asks a trie of abbreviations, read backwards, whether the full stop belongs to a word;
then the closing marks are popped and what follows decides. Inside a quotation no sentence ends if a reporting clause
stands before or after it. Offsets count code points.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

# Abbreviations that never end a sentence before a name or number.
TITLES = "dr mr ms mrs prof capt col gen lt sgt rev hon st sr sra srta dra d dña hr fr frl m mm mlle me pr v vs cf approx ca rd gem bzw vgl ggf inkl env bros messrs dott sig ing avv arch geom on prof.ssa arq exmo exma ilmo dhr mevr mw ds fa drs hr ds fru kand inż mgr ks pl os ул г пр пер д кв корп стр им т.е т.к т.д см ср гр тов акад доц проф гл св вул пл бул κ κα δρ हॉ डॉ श्री प्रो د أ".split()
# Abbreviations that do not end a sentence before a number.
BEFORE_NUMBER = "no nos nr num núm n p pp pg pág págs vol vols sec sect fig figs art arts ch cap para par ex exh bd kap abs s z ziff tab tbl jan feb febr mar apr jun jul aug sep sept oct nov dec ene abr ago dic janv févr avr juil déc okt dez ص رقم".split()
# Abbreviations of several parts, which do not end a sentence unless a capital letter follows a real end.
INNER = "i.e e.g d.h z.b u.a u.s.w o.ä v.a p.ej p.ex c.-à-d a.k.a t.ex t.o.m bl.a f.eks o.a d.w.z m.a.w n.b p.es т.е т.к и.о".split()
# Words after a reporting verb that give it an object of its own, so that it reports something else.
OBJECTS = set("that whether if how why dass daß ob wie que si comment pourquoi cómo".split())
# Words of a clause that reports speech.
REPORTING = set(
    "asked said replied answered wrote insisted added told testified noted shouted cried remarked stated declared called came recalled explained "
    "fragte sagte antwortete erklärte notierte schrieb rief meinte demanda dit répondit déclara nota écrivit demandé déclaré répondu "
    "preguntó dijo respondió declaró anotó escribió añadió contestó".split()
)
_CJK_REPORT = re.compile(r"\s*[^。！？!?“「\n]*?(?:问|說|说|道|称|答|表示|写道|喊|叫)[^。！？!?“「，\n]*[。！？!?]")
#: A reporting verb is looked for up to so many words into a clause; names don't count.
SUBJECT_WORDS = 5
_GERMAN_MONTH = re.compile(r"\s+(?:Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember)\b")

OPENERS = {"“": "”\"", "„": "“”\"", "«": "»", "‹": "›", "「": "」", "『": "』", "(": ")", "[": "]", "（": "）", "{": "}"}
QUOTES = set("“„«‹「『\"")
# Signs that end a sentence in scripts without letter case, or at any place in a line.
TERMINATORS = "。！？｡．؟۔।॥։።፧፨။។៕།༎᠃᠉܀܁܂꘎꘏꛳꛷᱾᱿᭞᭟꧈꧉‼⁇⁈⁉"
_LEVEL = r"\n[ \t]*(?:[-*•‣▪–][ \t]+|\(?\d{1,3}[.)][ \t]+|\(?[a-z]\)[ \t]+)"
_SIGN = re.compile(r"[“”„«»‹›「」『』\"()\[\]（）{}]|\n[ \t ]*\n\s*|(?=" + _LEVEL + r")\n[ \t]*|\n")
_END = re.compile(f"[.!?…{TERMINATORS}]+")
_THAI_GAP = re.compile(r"(?<=[฀-๿”\"»])[  \n]+(?=[฀-๿A-Z“\"«(])")
_LIST = re.compile(_LEVEL)
_CASELESS_END = set(TERMINATORS) - set("．")
#: Leftovers of markup that may stand before the first word of a sentence.
_MARKUP = re.compile(r"(?:[*_`']{1,3}|</?[a-z]\w*[^<>\n]*>|\[\[(?:[^\[\]|\n]*\|)?|\\[a-z]+\{)+")


def _trie(words: list[str]) -> dict:
    root: dict = {}
    for w in words:
        node = root
        for c in reversed(w):
            node = node.setdefault(c, {})
        node[""] = True
    return root


_TITLE_TRIE, _NUMBER_TRIE, _INNER_TRIE = _trie(TITLES), _trie(BEFORE_NUMBER), _trie(INNER)


def _ends_with(trie: dict, text: str, stop: int) -> int:
    """Start of an abbreviation of the trie that ends at ``stop`` as a word of its own, else -1."""
    i = stop
    while i > 0 and (trie := trie.get(text[i - 1].lower())) is not None:
        i -= 1
        if "" in trie and (i == 0 or not (text[i - 1].isalnum() or text[i - 1] == ".")):
            return i
    return -1


def _begins_item(text: str, at: int) -> bool:
    """Does the line break at ``at`` begin a new list item? The line before it must have come to an end, or be an item."""
    line = text.rfind("\n", 0, at) + 1
    return text[line:at].rstrip()[-1:] in tuple(".!?:;。") or bool(_LIST.match("\n" + text[line:at] + "\n"))


def matched(text: str) -> tuple[dict[int, int], dict[int, int]]:
    """(closing place by opening place, and the reverse) of quotations and brackets. A new list item ends what the items at
    its level or below it left open, a blank line ends all."""
    stack: list[tuple[int, str, int]] = []  # place, closing signs, level of a list item or -1
    close_of: dict[int, int] = {}
    waiting: Counter = Counter()  # how many open signs each closing sign would close
    for m in _SIGN.finditer(text):
        c, i = m[0], m.start()
        if c[0] == "\n":
            if "\n" in c[1:]:
                stack.clear()
                waiting.clear()
            elif _LIST.match(text, i) and _begins_item(text, i):
                level = len(c) - 1
                if any(x[2] >= 0 for x in stack):
                    while stack and not -1 < stack[-1][2] < level:
                        waiting.subtract(stack.pop()[1])
                elif text[i - 1 : i] != ":":  # the first item of a list closes the line before, unless that leads to it
                    stack.clear()
                    waiting.clear()
                stack.append((i, "", level))
            continue
        if waiting[c] > 0:
            while True:
                at, closers, _ = stack.pop()
                waiting.subtract(closers)
                if c in closers:
                    close_of[at] = i
                    break
        else:
            if c == '"':
                if i + 1 < len(text) and not text[i + 1].isspace():
                    stack.append((i, '"', -1))
                    waiting['"'] += 1
            elif c in OPENERS:
                stack.append((i, OPENERS[c], -1))
                waiting.update(OPENERS[c])
    return close_of, {b: a for a, b in close_of.items()}


_CLAUSE_SIGN = re.compile(r"[^\W\d_]+|[.!?;\n]")


def _reported_after(text: str, close: int) -> bool:
    """Does a clause that reports speech follow the quotation that closes here?"""
    at = close + 1
    while at < len(text) and text[at] in "  \t\n":
        at += 1
    if at == len(text):
        return False
    lead = text[at]
    if lead in ",;:、，—–-" or lead.islower():
        return True
    if "぀" <= lead <= "ヿ":
        return lead in "とっ"
    if "一" <= lead <= "鿿":
        return bool(_CJK_REPORT.match(text, at))
    counted = 0
    for m in _CLAUSE_SIGN.finditer(text, at):
        w = m[0]
        if w == "\n":
            continue
        if w in ".!?;":
            nxt = m.end()
            while nxt < len(text) and text[nxt].isspace():
                nxt += 1
            if w == "." and nxt < len(text) and not _stop_is_end(text, m.start(), nxt):
                continue
            return False
        if w in REPORTING:
            after = _CLAUSE_SIGN.search(text, m.end())
            return after is None or after[0] not in OBJECTS
        counted += m.start() == at or not w[0].isupper()
        if counted >= SUBJECT_WORDS:
            return False
    return False


def _stop_is_end(text: str, start: int, nxt: int) -> bool:
    """Is the single full stop at ``start`` an end mark? nxt: place of the next sign that is no space."""
    follow = text[nxt] if nxt < len(text) else ""
    if follow == "":
        return True
    if _ends_with(_INNER_TRIE, text, start) >= 0 or _ends_with(_TITLE_TRIE, text, start) >= 0:
        return False
    if _ends_with(_NUMBER_TRIE, text, start) >= 0 and (follow.isdigit() or follow in "#§" or re.match(r"[IVXLC]+\b", text[nxt : nxt + 8])):
        return False
    before = text[start - 1] if start else ""
    if before.isalpha() and (start < 2 or not (text[start - 2].isalnum() or text[start - 2] in "'’̀")):  # one letter
        if before.isupper():
            return False
        if text[start - 3 : start].lower() in ("p.m", "a.m"):
            return True
        unit = re.search(r"\d[  ]?$", text[max(0, start - 4) : start - 1])
        return bool(unit) if before.lower() != before.upper() or before in "دأ" else True
    if before.isdigit() and re.search(r"(?<!\d)\d{1,2}$", text[max(0, start - 3) : start]) and _GERMAN_MONTH.match(text, start + 1):
        return False
    return True


def boundaries(text: str) -> list[int]:
    """Places at which a sentence ends, in order; the rest of the text is a last sentence."""
    close_of, open_of = matched(text)
    cuts: set[int] = set()
    breaks = [m.start() for m in re.finditer(r"\n[ \t ]*\n", text)]
    cuts.update(breaks)
    cuts.update(m.start() for m in _LIST.finditer(text) if _begins_item(text, m.start()))
    opened = _Stack(sorted(close_of.items())).around

    if any("฀" <= c <= "๿" for c in text):
        for m in _THAI_GAP.finditer(text):
            a, b = text[m.start() - 1], text[m.end()]
            thai = ("฀" <= a <= "๿", "฀" <= b <= "๿")
            if not any(thai):
                continue
            if not thai[0] and not (m.start() - 1 in open_of and "฀" <= text[m.start() - 2] <= "๿"):
                continue
            if not opened(m.start()):
                cuts.add(m.start())

    opened = _Stack(sorted(close_of.items())).around
    order = sorted(cuts)

    def at_start(i: int) -> bool:
        """Does only white space lie between the last boundary and i?"""
        k = bisect.bisect_right(order, i)
        return not text[order[k - 1] if k else 0 : i].strip(" \xa0\u202f\t\n")

    for m in _END.finditer(text):
        run, i, end = m[0], m.start(), m.end()
        while True:  # pop the quotations and brackets that close here
            k = end
            while k < len(text) and text[k] in "   ":
                k += 1
            if k < len(text) and k in open_of and (k == end or text[k] in "»"):
                end = k + 1
                continue
            break
        nxt = end
        while nxt < len(text) and text[nxt].isspace():
            nxt += 1
        if nxt >= len(text):
            continue
        spaced, follow = nxt > end, text[nxt]
        if (lead := _MARKUP.match(text, nxt)) and lead.end() < len(text) and text[lead.end()].isalnum():
            follow = text[lead.end()]
        inside = opened(i if end == m.end() else end)
        closed = [open_of[b] for b in range(m.end(), end) if b in open_of]
        if any(text[a] not in QUOTES for a, _ in inside):
            continue
        if inside and any(not at_start(a) or _reported_after(text, b) for a, b in inside):
            continue
        broad = run[-1] in _CASELESS_END
        if not spaced and not broad and not ("぀" <= follow <= "鿿" and closed):
            if not (follow in OPENERS and text[end - 1] in "”\"»)」』" ):
                continue
        if follow in ",;:、，" or (follow in "—–" and text[nxt + 1 : nxt + 2] in ", "):
            continue
        outer = [a for a in closed if text[a] in QUOTES]
        if outer and not inside:
            first = min(outer)
            after = open_of and text[end - 1]
            if at_start(first):
                if _reported_after(text, end - 1) and after:
                    continue
            elif "぀" <= follow <= "ヿ" and follow in "とっ":
                continue
            elif follow.islower():
                continue
        if set(run) <= {"…"} or (len(run) > 1 and set(run) <= {".", "…"}):  # suspension points
            if i == 0 or text[i - 1].isspace() or not spaced or follow.islower() or follow.isdigit():
                continue
        elif run == ".":
            newline = "\n" in text[end:nxt]
            if follow.islower() and not (newline and not closed and _stop_is_end(text, i, len(text) - 1) and not _short(text, i)):
                continue
            if not closed and not _stop_is_end(text, i, nxt):
                continue
        elif follow.islower():
            continue
        bisect.insort(order, end)
    return sorted(set(order))


class _Stack:
    """The matched signs that are open at a place; asked for places in rising order."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.spans, self.next, self.open = spans, 0, []

    def around(self, i: int) -> list[tuple[int, int]]:
        while self.next < len(self.spans) and self.spans[self.next][0] < i:
            self.open.append(self.spans[self.next])
            self.next += 1
        while self.open and self.open[-1][1] <= i:
            self.open.pop()
        return [x for x in self.open if x[1] > i]


def _short(text: str, stop: int) -> bool:
    """Is the word before the full stop so short, or so dotted, that it may be an unknown abbreviation?"""
    word = re.search(r"\S*$", text[max(0, stop - 30) : stop])[0]
    return len(word) <= 4 or "." in word


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences, in order, without white space around them; a blank text has none."""
    out, last = [], 0
    for cut in [*boundaries(text), len(text)]:
        part = text[last:cut]
        if body := part.strip():
            start = last + len(part) - len(part.lstrip())
            out.append((start, start + len(body)))
        last = cut
    return out


def sentences(df: DataFrame) -> DataFrame:
    """(tab, row_id, sentence_no, start_at, end_at, sentence) of df (tab, row_id, text).

    Null, empty and blank texts have no sentences; repeated rows give repeated sentences. Map-only.
    """
    kind = df.schema["row_id"].dataType.simpleString()

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(rows):
            out = []
            for tab, row, text in pdf.itertuples(index=False):
                out += [(tab, row, k, a, b, text[a:b]) for k, (a, b) in enumerate(sentence_spans(text))]
            yield pd.DataFrame(out, columns=["tab", "row_id", "sentence_no", "start_at", "end_at", "sentence"])

    texts = df.filter(F.col("text").isNotNull()).select("tab", "row_id", "text")
    return texts.mapInPandas(run, f"tab string, row_id {kind}, sentence_no int, start_at int, end_at int, sentence string")
