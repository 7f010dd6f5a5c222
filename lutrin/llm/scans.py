"""Noise in text from scanned pages (problem 1): find it, and give back continuous paragraphs.

Words are grouped by a skeleton in which characters that scanners confuse are the same strokes; inside a
group the frequent form stands for the rare ones that a listed confusion can turn it into. Running
headers are lines that, with digits masked, stand at the top of pages more often than elsewhere. Lines
are put together again to paragraphs by SQL windows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lutrin.plans.scale import hot_keys, running_sum, written

# What a scanner reads, and what stood there.
CONFUSIONS = (
    "1 l,1 i,0 o,5 s,6 é,9 g,8 b,@ a,( c,c e,e c,f t,t f,l t,t l,l i,i l,y v,v y,b h,h b,rn m,m rn,ii u,u ii,h li,li h,m in,in m,n ri,ri n,d cl,cl d,i_ l,i) d,6 e,é 6"
)
PAIRS = tuple(tuple(p.split(" ")) for p in CONFUSIONS.split(","))
# The strokes of each character; what is not listed stands for itself.
STROKES = str.maketrans(
    {c: "i" for c in "iltfrj1|"} | {c: "ii" for c in "nuhb8"} | {"m": "iii", "d": "ci"} | {c: "c" for c in "ecé(6"} | {"0": "o", "5": "s", "@": "a", "y": "v", "9": "g", "2": "z", "_": ""}
)
MARKS = "\u00ac\u00ad\u2010\u2011"
#: Most frequent certain words that need no look-up; the rest is joined, so the number changes no result.
KNOWN_WORDS = 20_000
#: Headers handed to the Python workers; beyond it they are found by a join.
MOST_HEADERS = 100_000
FLUSH = 200_000
#: How many times as frequent a form must be to stand for another one of letters only, whatever is beside it.
FREQUENT = 8
#: Neighbours that must speak for a form before a word is taken for misread that frequency alone would leave.
LEAST_SUPPORT = 2

_WORD = re.compile(r"[\w@(]+(?:(?<=\bi)\)\w+)?")
_NUM = r"[\dOlSZIB]*\d[\dOlSZIB]*"
_NUMBER = re.compile(rf"(?<![^\W_])(?:{_NUM}|[OlSZIB])(?![^\W_])")
_PAGE = re.compile(r"\s*(?:Page\s+([\dOlSZIB]+)\s+sur\s+[\dOlSZIB]+|\[\s*([\dOlSZIB]+)\s*\]|([\dOlSZIB]+)\s*/\s*[\dOlSZIB]+|p\.\s*([\dOlSZIB]+)|[-–—]\s+([\dOlSZIB]+)\s+[-–—])\s*", re.I)
_BARE = re.compile(rf"\s*({_NUM})\s*")
_WITH_NUMBER = re.compile(rf"\s*(?:({_NUM})\s{{2,}}(\S.*?)|(\S.*?)\s{{2,}}({_NUM}))\s*")
_BREAK = re.compile(rf"([^\W\d_]|[\w@(])([-{MARKS}])\s*\Z")
_TABLE = re.compile(r"\s*(?:[A-Z0-9]{2,3}\s+[\dOlSZIB]{2,3}-[\dOlSZIB]+\s+[A-Z]{2}\s+[\dOlSZIB]{4}|[\dOlSZIB]{1,2}er?\s+[\dOlSZIB]+\s+\S+\s+[A-Z]{2}\s)")
_MIXED = re.compile(rf"(?<![\w.,/])(?:[\dOlSZIB]+)(?:[.,/-][\dOlSZIB]+)*(?![\w])|(?<=[A-Z]\.)[\dOlSZIB]+(?:\.[\dOlSZIB]+)*(?!\w)")
_INSIDE = re.compile(r"[0156@(89_](?<=[a-zà-ÿœ][0156@(89_])(?=[a-zà-ÿœ])")
_DIGIT_BESIDE = re.compile(r"[OlSZIB](?:(?<=\d.)|(?=\d)|(?<=[A-Z]\..)(?!\w))")
ENDS = ("-", *MARKS)


def skeleton(word: str) -> str:
    return word.lower().replace("i)", "d").translate(STROKES)


def mask(line: str) -> str:
    """The line with numbers as #, in strokes, letters only: equal for all readings of one header."""
    return re.sub(r"[^\w#]", "", skeleton(_NUMBER.sub("#", line.replace("I)", "D"))))


def aligned(read: str, true: str) -> tuple[tuple[int, str, str], ...] | None:
    """(position in `read`, what stands there, what stood there) of the listed confusions that turn `true` into
    `read`; None if none do."""
    stack, seen = [(0, 0, ())], set()
    while stack:
        i, j, at = stack.pop()
        if i == len(read) and j == len(true):
            return at or None
        if (i, j) in seen:
            continue
        seen.add((i, j))
        for a, b in PAIRS:
            if read.startswith(a, i) and true.startswith(b, j):
                stack.append((i + len(a), j + len(b), (*at, (i, a, b))))
        if i < len(read) and j < len(true) and read[i] == true[j]:
            stack.append((i + 1, j + 1, at))
    return None


def misread(read: str, true: str) -> list[int] | None:
    """Positions in `read` at which listed confusions turn `true` into it; None if they cannot."""
    parts = aligned(read, true)
    return None if parts is None else [i for i, _, _ in parts]


def restored(shown: str, true: str) -> str:
    """The word as it stands in the text with its misread characters put right; all others keep their case."""
    capitals = shown.upper() == shown and sum(c.isalpha() for c in shown) > 1
    parts = aligned(shown.lower(), true) if len(shown.lower()) == len(shown) else None
    if parts is None:
        return true.upper() if capitals else true[0].upper() + true[1:] if shown[0].isupper() else true
    out, at = [], 0
    for i, a, b in parts:
        first = i == 0 and shown[0].isupper()
        out += [shown[at:i], b.upper() if capitals else b[0].upper() + b[1:] if first else b]
        at = i + len(a)
    return "".join([*out, shown[at:]])


#: What a digit or sign between letters most likely was, where no word of the collection tells: the first in the list.
_LIKELY = {a: b for a, b in reversed(PAIRS) if len(a) == 1 and not a.isalpha()} | {"_": ""}


def likely(shown: str) -> str:
    """The word with digits and signs between letters as the letters they are most often read for."""
    inside = {m.start() for m in _INSIDE.finditer(shown.lower())} if len(shown.lower()) == len(shown) else set()
    capitals = shown.upper() == shown
    return "".join((_LIKELY[c].upper() if capitals else _LIKELY[c]) if i in inside else c for i, c in enumerate(shown))


def numeric(text: str) -> str:
    """A misread number as digits."""
    return text.translate(str.maketrans("OlSZIB", "015218"))


def _printed(line: str) -> re.Match | None:
    """A page number in one of the forms that are nothing else."""
    m = _PAGE.fullmatch(line)
    return m if m and (any(c.isdigit() for c in line) or m.group(5) is not None or m.group(2) is not None) else None


def _page_number(lines: list[str], body: list[int], k: int, page: int | None, is_header, offsets: set[int]) -> bool:
    """Whether body line k is a page number standing alone. offsets: how far printed numbers of the collection lie
    above the number of their page."""
    line = lines[body[k]]
    if _printed(line):
        return True
    m = _BARE.fullmatch(line)
    if not m:
        return False
    before = lines[body[k - 1]] if k else ""
    after = lines[body[k + 1]] if k + 1 < len(body) else ""
    table = bool(_TABLE.match(before))
    if after and (is_header(after)):
        return True
    if k and is_header(before):
        return not _TABLE.match(after) or page is None
    if page is not None:  # a page of a file: only its edges
        if k not in (0, 1, len(body) - 1):
            return False
        if table or _BARE.fullmatch(before):
            return int(numeric(m.group(1))) - page in offsets
        return k == len(body) - 1 or k == 0 and not _TABLE.match(after)
    if table or _BARE.fullmatch(before) or k == 0:
        return k == 0 and bool(after) and not _TABLE.match(after)
    return True


def _may_be_header(line: str) -> bool:
    """Headers begin with a capital or a number and do not end like a sentence."""
    return (line[0].isupper() or line[0].isdigit() or line[0] == " " or line[:1] in "([l") and line[-1] not in ".,;"


#: How a line with a page number ends, white space aside.
_NUMBER_END = frozenset("0123456789OlSZIBo]-–—")


def furniture(lines: list[str], page: int | None, is_header, offsets: set[int] = frozenset()) -> set[int]:
    """Numbers (from 0) of the lines that are a running header, a page number or both."""
    body = [i for i, x in enumerate(lines) if x and not x.isspace()]
    out = set()
    for k, i in enumerate(body):
        line = lines[i]
        if _may_be_header(line) and is_header(line) or line.rstrip()[-1] in _NUMBER_END and _page_number(lines, body, k, page, is_header, offsets):
            out.add(i)
    return out


def header_test(masks) -> object:
    """Whether a line is one of the headers, alone or beside a page number. Lines whose first word begins no header are
    told by that word."""
    kept: dict[str, bool] = {}
    firsts: dict[str, bool] = {}
    begins = {m[:k] for m in masks for k in range(1, 9)}

    def test(line: str) -> bool:
        first = line.split(None, 1)[0]
        if (may := firsts.get(first)) is None:
            if len(firsts) > FLUSH:
                firsts.clear()
            word = mask(first)[:8]
            may = firsts[first] = not word or word[0] == "#" or word in begins
        if not may:
            return False
        known = kept.get(line)
        if known is None:
            m = _WITH_NUMBER.fullmatch(line)
            known = mask(line) in masks or bool(m) and mask(m.group(2) or m.group(3)) in masks
            if len(kept) > FLUSH:
                kept.clear()
            kept[line] = known
        return known

    return test


_PLAIN_BREAK = re.compile(r"-[^\S\n]*\n\s*([\w@(]+)")
_MARK_BREAK = re.compile(rf"[{MARKS}]\s*\n\s*")
_COMPOUND = re.compile(r"(?<![\w-])[^\W\d_]+(?:-[^\W\d_]+)+")


def _counts(texts: Iterable[tuple[str | None, int | None]]) -> Iterator[tuple[str, str, int, int]]:
    """Partial (kind, key, n, edge): words (w), words joined over a plain hyphen at a line's end (j), hyphenated
    compounds (c), masked lines and how often at a page's top (h), offsets of printed page numbers (o)."""
    pieces, halves, joined, compounds, total, edge, offsets = (Counter() for _ in range(7))
    of: dict[str, str] = {}

    def masked(line: str) -> str:
        if len(of) > FLUSH:
            of.clear()
        if (x := of.get(line)) is None:
            m = _WITH_NUMBER.fullmatch(line)
            x = of[line] = mask((m.group(2) or m.group(3)) if m else line)
        return x

    def flush():
        words = Counter(halves)
        for piece, n in pieces.items():  # words never hold a space: each different piece is taken apart once
            for w in _WORD.findall(piece):
                words[w] += n
            if "-" in piece:
                for w in _COMPOUND.findall(piece):
                    compounds[w] += n
        for kind, c in (("w", words), ("j", joined), ("c", compounds), ("o", offsets)):
            yield from ((kind, k, n, 0) for k, n in c.items() if n)
        yield from (("h", k, n, edge[k]) for k, n in total.items())
        for c in (pieces, halves, joined, compounds, total, edge, offsets):
            c.clear()

    for text, page in texts:
        if not text:
            continue
        whole = (_MARK_BREAK.sub("", text) if any(c in text for c in MARKS) else text).lower()
        pieces.update(whole.split())
        if "-" in whole:
            for m in _PLAIN_BREAK.finditer(whole):
                end = start = m.start()
                while start and (whole[start - 1].isalnum() or whole[start - 1] in "_@("):
                    start -= 1
                if a := whole[start:end]:
                    # The halves are no words; what the whole is, compounds and words elsewhere will tell.
                    b = m.group(1)
                    halves[a] -= 1
                    halves[b] -= 1
                    joined[a + b] += 1
        body = [x for x in text.split("\n") if x and not x.isspace()]
        # The four lines after a page's top are its control group: a line of the text is as likely to be the first
        # of a page as any of the others. That does not hold for a file's first page, which begins with its title
        # or first heading and so says nothing about headers; headers known from other pages are found on it.
        if page is None:
            tops = [k for k in range(1, len(body)) if body[k - 1].rstrip()[-1] in _NUMBER_END and _PAGE.fullmatch(body[k - 1])]
        else:
            tops = [0] if page != 1 else []
            for line in {x for x in (*body[:2], *body[-1:]) if x.rstrip()[-1] in _NUMBER_END}:
                if (m := _printed(line)) and (g := next((x for x in m.groups() if x), "")) and (n := numeric(g)).isdigit():
                    offsets[str(int(n) - page)] += 1
        for top in tops:
            skip = 1 if page is None else 2
            for k in (top, *range(top + skip, top + skip + 4)):
                if k < len(body) and _may_be_header(body[k]) and not _TABLE.match(body[k]):
                    key = masked(body[k])
                    total[key] += 1
                    edge[key] += k == top
        if len(pieces) + len(total) > FLUSH:
            yield from flush()
    yield from flush()


def statistics(rows: DataFrame) -> DataFrame:
    """(kind, key, n, edge) over all rows (origin, row_id, path, page, text), combined before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def texts():
            for b in batches:
                yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist())

        block: list[tuple] = []
        for row in _counts(texts()):
            block.append(row)
            if len(block) >= 50_000:
                yield _batch(block, "kind key n edge")
                block = []
        yield _batch(block, "kind key n edge")

    partial = rows.select("text", "page").mapInArrow(run, "kind string, key string, n long, edge long")
    return partial.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("edge").alias("edge"))


_TYPES = {"n": pa.int64(), "edge": pa.int64(), "row_id": pa.int64(), "line_no": pa.int32(), "next_line": pa.int32(), "cut": pa.int32(), "page": pa.int32()}


def _batch(block: list[tuple], names: str) -> pa.RecordBatch:
    columns = list(zip(*block)) if block else [()] * len(names.split())
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES.get(n, pa.string())) for n, c in zip(names.split(), columns)], names.split())


def candidates(stats: DataFrame) -> DataFrame:
    """(read, true, n, true_n, at, firm): words of the same skeleton, the second at least as frequent, from which listed
    confusions lead to the first. firm: the frequencies alone say that it was misread; a form with a digit or sign
    among its letters yields to any form as frequent, one of letters only to a form FREQUENT times as frequent.
    """
    counted = stats.where("kind IN ('w', 'j') AND NOT key RLIKE '^[0-9]+$'").groupBy(F.col("key").alias("word")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("kind") == "w", F.col("n")).otherwise(0)).alias("alone"))
    words = counted.withColumn("skeleton", _skeleton_sql(F.col("word"))).where((F.length("word") > 1) & (F.col("n") > 0))
    odd = F.col("word").rlike("[0-9@(_)]")
    # Words joined over a line's end may be misread ones, but are no proof of how a word is spelt.
    letters = words.where(~odd & (F.length("word") > 2) & (F.col("alone") > 0)).select("skeleton", F.col("word").alias("true"), F.col("alone").alias("true_n"))
    firm = F.when(F.col("odd"), F.lit(True)).otherwise((F.col("true_n") >= FREQUENT * F.col("n")) & (F.col("true_n") >= FREQUENT))
    pairs = words.select("skeleton", F.col("word").alias("read"), "n", odd.alias("odd")).join(letters, "skeleton").where((F.col("read") != F.col("true")) & (F.col("true_n") >= F.col("n"))).withColumn("firm", firm)

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["read", "true", "n", "true_n", "at", "firm"], (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.bool_())
        for b in batches:
            rows = [(r, t, n, m, misread(r, t), f) for r, t, n, m, f in zip(*(c.to_pylist() for c in b.columns))]
            rows = [x for x in rows if x[4]]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], names)

    return pairs.select("read", "true", "n", "true_n", "firm").mapInArrow(positions, "read string, true string, n long, true_n long, at array<int>, firm boolean")


def readings(found: DataFrame) -> DataFrame:
    """(read, true, at): of the firm candidates of a word the most frequent, then the smallest."""
    return found.where("firm").groupBy("read").agg(F.min_by(F.struct("true", "at"), F.struct((-F.col("true_n")).alias("n"), "true")).alias("b")).select("read", "b.true", "b.at")


def open_readings(found: DataFrame, sure: DataFrame) -> DataFrame:
    """(read, true, at, firm): words whose neighbours have to decide. Either several candidates are about as frequent,
    or one is more frequent, but not so much that frequency alone would do. Candidates that are misread
    themselves do not count."""
    best = found.where("firm").groupBy("read").agg(F.max("true_n").alias("best"))
    sound = found.join(sure.select(F.col("read").alias("true")), "true", "left_anti").join(best, "read", "left")
    near = sound.where((F.col("firm") & (F.col("true_n") * FREQUENT >= F.col("best"))) | (F.col("best").isNull() & (F.col("true_n") > LEAST_SUPPORT)))
    several = near.groupBy("read").agg(F.count(F.lit(1)).alias("several"))
    return near.join(several, "read").where("several > 1 OR NOT firm").select("read", "true", "at", "firm")


def _skeleton_sql(word):
    one = {k: v for k, v in ((chr(a), b) for a, b in STROKES.items()) if len(v) == 1}
    gone = [chr(a) for a, b in STROKES.items() if b == ""]
    word = F.replace(word, F.lit("i)"), F.lit("d"))
    # Characters of several strokes are spelled out last, with letters that no other rule touches.
    word = F.translate(word, "".join(one) + "".join(gone), "".join(one.values()))
    for c, strokes in ((chr(a), b) for a, b in STROKES.items() if len(b) > 1):
        word = F.replace(word, F.lit(c), F.lit(strokes))
    return word


def headers(stats: DataFrame) -> DataFrame:
    """(key): masked lines that stand at the top of pages more often than a line of the text would.

    Of a text line's places that are counted, one in five is the top. A line counts as a header if at
    least half of its places are and if chance would not bring that about for any of the candidate lines
    (likelihood ratio against one in five, with the 5 % level divided by their number).
    """
    lines = stats.where("kind = 'h' AND key <> '' AND key <> '#' AND edge > 0")
    candidates = lines.count()
    n, e = F.col("n").cast("double"), F.col("edge").cast("double")
    ratio = e * F.ln(e / (0.2 * n)) + F.when(n > e, (n - e) * F.ln((n - e) / (0.8 * n))).otherwise(F.lit(0.0))
    return lines.where((2 * e >= n) & (ratio >= math.log(max(candidates, 1) / 0.05))).select("key")


#: A difference between printed and stored page number counts if it makes up this share of all that are certain.
OFFSET_SHARE = 0.005


def page_offsets(stats: DataFrame) -> set[int]:
    """How far printed page numbers lie above the stored ones; at most 1 / OFFSET_SHARE differences."""
    o = stats.where("kind = 'o'")
    whole = o.agg(F.sum("n").alias("whole"))
    return {int(r["key"]) for r in o.crossJoin(F.broadcast(whole)).where(F.col("n") >= OFFSET_SHARE * F.col("whole")).select("key").collect()}  # whole: one row


def doubts_of(known: set[str]):
    """The words of a text that are neither certain nor numbers, by a memory of the pieces that have none."""
    clean: set[str] = set()

    def doubtful(text: str) -> set[str]:
        if len(clean) > FLUSH:
            clean.clear()
        out: set[str] = set()
        for piece in set(text.split()).difference(clean):
            words = [w for w in _WORD.findall(piece) if w not in known and not w.isdigit()]
            out.update(words)
            if not words:
                clean.add(piece)
        return out

    return doubtful


def _scan(texts: Iterable[tuple], known: set[str], is_header, doubtful_words, offsets: set[int] = frozenset()) -> Iterator[tuple]:
    """(origin, row_id, path, page, what, line_no, next_line, cut, word, rest) of each row's noise and doubtful words."""
    for origin, row, path, page, text in texts:
        if not text:
            continue
        lines = text.split("\n")
        is_page = origin == "doc_pages"
        fur = furniture(lines, page if is_page else None, is_header, offsets)
        for i in sorted(fur):
            yield origin, row, path, page, "furniture", i + 1, None, None, None, None
        ends = [i for i, x in enumerate(lines) if x and (x[-1] in ENDS or x.rstrip()[-1:] in ENDS)]
        low = text.lower()
        joined = _JOIN.sub("", low) if ends else low
        doubtful = doubtful_words(joined)
        if _DIGIT_BESIDE.search(text) or _INSIDE.search(low):
            yield from ((origin, row, path, page, "glyph", i + 1, None, None, t, None) for i, t in _plain_glyphs(lines, fur))
        body = [i for i, x in enumerate(lines) if i not in fur and x and not x.isspace()]
        if doubtful or ends:
            yield from ((origin, row, path, page, *x) for x in _doubts(lines, body, set(ends), doubtful, known))
        if is_page and body and (m := re.match(r"\s*([\w@(]+)", lines[body[0]])):
            yield origin, row, path, page, "top", body[0] + 1, None, None, m.group(1).lower(), None


_JOIN = re.compile(rf"[-{MARKS}]\s*\n\s*")


def _plain_glyphs(lines: list[str], fur: set[int]) -> Iterator[tuple[int, str]]:
    """(line, characters) that no spelling has: a digit or sign between small letters, letters in a number."""
    for i, line in enumerate(lines):
        if i in fur:
            continue
        for m in _MIXED.finditer(line) if _DIGIT_BESIDE.search(line) else ():
            t = m.group(0)
            if any(c.isdigit() for c in t) and any(c.isalpha() for c in t):
                yield i, t
        if m := _INSIDE.search(line.lower()):
            yield i, m.group(0)


def _doubts(lines: list[str], body: list[int], ends: set[int], doubtful: set[str], known: set[str]) -> Iterator[tuple]:
    eaten = 0  # characters of the line that belong to a word begun on the line before
    for k, i in enumerate(body):
        line, start = lines[i], eaten
        eaten, end = 0, len(line)
        if i in ends and (broken := _BREAK.search(line)) and not _TABLE.match(line):
            first = re.search(r"[\w@(]+\Z", line[: broken.start(2)])
            head = first.group(0) if first else ""
            nxt = body[k + 1] if k + 1 < len(body) else None
            rest = re.match(r"\s*([\w@(]+)", lines[nxt]) if nxt is not None else None
            if head and not head.isdigit():
                end = first.start()
                tail = rest.group(1) if rest else None
                yield "break" if broken.group(2) == "-" else "hyphen", i + 1, None if nxt is None else nxt + 1, len(head), head.lower(), tail.lower() if tail else None
                if nxt is not None:
                    word = (head + (tail or "")).lower()
                    if word not in known and not word.isdigit():
                        yield "word", i + 1, nxt + 1, len(head), word, None
                    eaten = rest.end() if rest else 0
        if doubtful:
            part = (line[start:end] if start or end < len(line) else line).lower()
            if not (here := [w for w in doubtful if w in part]):
                continue
            words = _WORD.findall(part)
            for w in here:
                if w not in words:
                    continue
                at = words.index(w)
                # With the words beside it: words hold no spaces.
                yield "word", i + 1, None, None, w, f"{words[at - 1] if at else ''} {words[at + 1] if at + 1 < len(words) else ''}"


_SCAN = "origin row_id path page what line_no next_line cut word rest"


def with_headers(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows with `masks`, the headers among their lines: the way for more headers than a worker should hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            block = []
            for origin, row, text in zip(*(c.to_pylist() for c in b.columns)):
                for line in {x for x in (text or "").split("\n") if x and not x.isspace() and _may_be_header(x)}:
                    m = _WITH_NUMBER.fullmatch(line)
                    block += [(origin, row, k) for k in {mask(line), mask(m.group(2) or m.group(3)) if m else ""} if k]
            yield _batch(block, "origin row_id key")

    lines = rows.select("origin", "row_id", "text").mapInArrow(run, "origin string, row_id long, key string")
    mine = lines.join(found, "key", "left_semi").groupBy("origin", "row_id").agg(F.collect_set("key").alias("masks"))
    return rows.join(mine, ["origin", "row_id"], "left")


def scan(rows: DataFrame, known: list[str], masks: list[str] | None, offsets: set[int] = frozenset()) -> DataFrame:
    """Noise and doubtful words of rows. masks: all headers, or None where each row has its own."""
    known_set, mask_set = set(known), set(masks or ())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, doubtful = header_test(mask_set), doubts_of(known_set)

        def found():
            for b in batches:
                for row in zip(*(c.to_pylist() for c in b.columns)):
                    yield from _scan([row[:5]], known_set, shared if masks is not None else header_test(set(row[5] or ())), doubtful, offsets)

        block: list[tuple] = []
        for row in found():
            block.append(row)
            if len(block) >= 20_000:
                yield _batch(block, _SCAN)
                block = []
        yield _batch(block, _SCAN)

    schema = "origin string, row_id long, path string, page int, what string, line_no int, next_line int, cut int, word string, rest string"
    return rows.select("origin", "row_id", "path", "page", "text", *(["masks"] if masks is None else [])).mapInArrow(run, schema)


class Noise:
    """The noise of a set of rows (origin, row_id, path, page, text); page is null where rows are no pages.

    Statistics are counts over every row. Null and empty texts have no noise; repeated rows are judged
    one by one; row_id must tell rows of one origin apart.
    """

    def __init__(self, rows: DataFrame):
        self.rows = rows
        self.stats = written(statistics(rows), "scan-stats")
        found_words = written(candidates(self.stats), "candidates")
        self.readings = written(readings(found_words), "readings")
        self.open = written(open_readings(found_words, self.readings), "open")
        found = headers(self.stats)
        head = [r[0] for r in found.limit(MOST_HEADERS + 1).collect()]
        few = len(head) <= MOST_HEADERS
        # Words that neighbours decide on are looked up on both sides, the misread and the true ones.
        asked = self.readings.select("read").union(self.open.select("read")).union(self.open.select("true")).distinct()
        certain = self.stats.where("kind = 'w'").join(asked, F.col("key") == F.col("read"), "left_anti")
        known = [r[0] for r in certain.orderBy(F.col("n").desc(), "key").limit(KNOWN_WORDS).select("key").collect()]
        self.marks = written(scan(rows if few else with_headers(rows, found), known, head if few else None, page_offsets(self.stats)), "scan")

    def breaks(self) -> DataFrame:
        """(origin, row_id, line_no, next_line): lines that end inside a word broken to fit the line.

        For a plain hyphen the joined word and the hyphenated compound are compared by frequency; where
        the rest is unknown, compounds that begin with the word and longer words that do.
        """
        m = self.marks
        top = m.where("what = 'top'").groupBy("path", F.col("page").alias("at")).agg(F.min("word").alias("top"))
        end = m.where("what = 'break'")
        joined = end.alias("e").join(top.alias("t"), F.col("e.rest").isNull() & (F.col("e.path") == F.col("t.path")) & (F.col("e.page") + 1 == F.col("t.at")) & (F.col("e.origin") == "doc_pages"), "left")
        cand = joined.select("e.origin", "e.row_id", "e.line_no", "e.next_line", F.col("e.word").alias("head"), F.coalesce("e.rest", "t.top").alias("rest"))
        count = self.stats
        # Each lookup is by skeleton, so that misread parts find their word.
        words = count.where("kind = 'w' AND n > 0").groupBy(_skeleton_sql(F.col("key")).alias("k")).agg(F.sum("n").alias("n_word"))
        comp = count.where("kind = 'c'").select(F.split("key", "-").alias("p"), "n")
        comp = comp.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.struct(F.element_at("p", i).alias("a"), F.element_at("p", i + 1).alias("b")))).alias("x"), "n")
        both = comp.groupBy(F.concat_ws("-", _skeleton_sql(F.col("x.a")), _skeleton_sql(F.col("x.b"))).alias("k")).agg(F.sum("n").alias("n_comp"))
        lefts = comp.groupBy(_skeleton_sql(F.col("x.a")).alias("k")).agg(F.sum("n").alias("n_left"))
        # Only beginnings as long as one that is asked for are counted: a few lengths, of any size.
        lengths = [r[0] for r in cand.where("rest IS NULL").select(F.length("head").alias("i")).distinct().collect()]
        of_length = F.explode(F.filter(F.array(*[F.lit(i) for i in sorted(lengths)]).cast("array<int>"), lambda i: i < F.length("key")))
        pre = count.where("kind = 'w'").select("key", "n", of_length.alias("i"))
        pre = pre.groupBy(F.expr("substring(key, 1, i)").alias("k")).agg(F.sum("n").alias("n_pre"))
        known = cand.where("rest IS NOT NULL").withColumn("kw", _skeleton_sql(F.concat("head", "rest"))).withColumn("kc", F.concat_ws("-", _skeleton_sql(F.col("head")), _skeleton_sql(F.col("rest"))))
        known = known.join(words, F.col("kw") == F.col("k"), "left").drop("k").join(both, F.col("kc") == F.col("k"), "left").drop("k")
        w, c = F.coalesce("n_word", F.lit(0)), F.coalesce("n_comp", F.lit(0))
        yes = (w > c) | ((w == 0) & (c == 0) & ~F.col("rest").rlike("^[0-9]"))
        open_ = cand.where("rest IS NULL").join(lefts, _skeleton_sql(F.col("head")) == F.col("k"), "left").drop("k").join(pre, F.col("head") == F.col("k"), "left")
        unsure = (F.coalesce("n_left", F.lit(0)) == 0) | (F.coalesce("n_left", F.lit(0)) * 2 < F.coalesce("n_pre", F.lit(0)))
        sure = m.where("what = 'hyphen'")
        cols = ["origin", "row_id", "line_no", "next_line"]
        return sure.select(*cols).unionByName(known.where(yes).select(*cols)).unionByName(open_.where(unsure).select(*cols))

    def fixes(self) -> DataFrame:
        """(origin, row_id, line_no, next_line, cut, read, true, at): misread words with what stood there; next_line
        where one goes over a line's end.

        Most are told by frequency alone. Of an open reading the candidate is taken that most often has the
        same word before or after it elsewhere: among firm candidates always one (the most frequent, if the
        neighbours do not tell), else only if it has LEAST_SUPPORT and more than the word as it stands.
        """
        key = ["origin", "row_id", "line_no", "next_line", "cut"]
        marks = self.marks.where("what = 'word'")
        plain = marks.join(self.readings, F.col("word") == F.col("read")).select(*key, "read", "true", "at")
        words = self.open.select(F.col("read").alias("w")).union(self.open.select(F.col("true").alias("w"))).distinct()
        sides = F.split(F.coalesce("rest", F.lit(" ")), " ", -1)
        seen = marks.join(words, F.col("word") == F.col("w"), "left_semi").select(F.col("word").alias("w"), F.posexplode(sides).alias("side", "beside")).where("beside <> ''")
        seen = seen.groupBy("w", "side", "beside").agg(F.count(F.lit(1)).alias("times"))
        of = lambda w, name: seen.select(F.col("w").alias(w), "side", "beside", F.col("times").alias(name))
        each = marks.join(self.open, F.col("word") == F.col("read")).select(*key, "read", "true", "at", "firm", F.posexplode(sides).alias("side", "beside"))
        each = each.join(of("true", "for_it"), ["true", "side", "beside"], "left").join(of("read", "against"), ["read", "side", "beside"], "left")
        # A word's own place speaks neither way.
        told = each.groupBy(*key, "read", "true", "firm").agg(F.first("at").alias("at"), F.sum(F.coalesce("for_it", F.lit(0))).alias("support"), F.sum(F.greatest(F.coalesce("against", F.lit(0)) - 1, F.lit(0))).alias("own"))
        chosen = told.where((F.col("firm") & (F.col("support") > 0)) | ((F.col("support") >= LEAST_SUPPORT) & (F.col("support") > F.col("own"))))
        best = chosen.groupBy(*key, "read").agg(F.min_by(F.struct("true", "at"), F.struct((-F.col("support")).alias("s"), "true")).alias("b"))
        same = [F.col(f"p.{c}").eqNullSafe(F.col(f"c.{c}")) for c in ("next_line", "cut")] + [F.col(f"p.{c}") == F.col(f"c.{c}") for c in ("origin", "row_id", "line_no", "read")]
        rest = plain.alias("p").join(best.alias("c"), same, "left_anti").select(*key, "read", "true", "at")
        return rest.unionByName(best.select(*key, "read", "b.true", "b.at"))

    def glyphs(self) -> DataFrame:
        """(origin, row_id, line_no, read): misread words on the line of the misread character."""
        words = self.fixes()
        lines = F.array_distinct(F.transform("at", lambda p: F.when(F.col("next_line").isNotNull() & (p >= F.col("cut")), F.col("next_line")).otherwise(F.col("line_no"))))
        words = words.select("origin", "row_id", F.explode(lines).alias("line_no"), "read")
        return words.unionByName(self.marks.where("what = 'glyph'").select("origin", "row_id", "line_no", F.col("word").alias("read")))

    def found(self) -> DataFrame:
        """(origin, row_id, line_no, kind)."""
        fur = self.marks.where("what = 'furniture'").select("origin", "row_id", "line_no", F.lit("furniture").alias("kind"))
        hyp = self.breaks().select("origin", "row_id", "line_no", F.lit("hyphen").alias("kind"))
        gly = self.glyphs().select("origin", "row_id", "line_no", F.lit("glyph").alias("kind"))
        return fur.unionByName(hyp).unionByName(gly).distinct()

    def edits(self) -> DataFrame:
        """(origin, row_id, edits): all that is to be done to a row, one row for each that needs anything."""
        ids, none = ["origin", "row_id"], lambda t: F.lit(None).cast(t)
        one = lambda kind, line=None, nxt=None, read=None, true=None: F.struct(
            F.lit(kind).alias("kind"), (line if line is not None else none("int")).cast("int").alias("line_no"), (nxt if nxt is not None else none("int")).cast("int").alias("next_line"),
            (read if read is not None else none("string")).alias("read"), (true if true is not None else none("string")).alias("true")).alias("e")
        c = F.col
        parts = self.marks.where("what = 'furniture'").select(*ids, one("furniture", c("line_no")))
        parts = parts.unionByName(self.breaks().select(*ids, one("hyphen", c("line_no"), c("next_line"))))
        parts = parts.unionByName(self.fixes().select(*ids, one("word", c("line_no"), c("next_line"), c("read"), c("true"))))
        pages = self.rows.where("page IS NOT NULL AND path IS NOT NULL").select(*ids, "path", "page")
        again = pages.groupBy("origin", "path", "page").agg(F.min("row_id").alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        twice = pages.join(again, ["origin", "path", "page"]).where("row_id > kept").select(*ids, one("twice"))
        return parts.unionByName(twice).groupBy(*ids).agg(F.collect_list("e").alias("edits"))

    def paragraphs(self) -> DataFrame:
        """(origin, path, row_id, page, paragraph, text): continuous paragraphs.

        A row's edits meet its text once, and it is mended and reflowed on its own (`reflowed`). A page's first
        paragraph is then added to the last of the page before (same path, number one less) if that ends without a
        closing sign; row_id and page are those of its start. Only the edges of pages take part in that, found
        by windows. Rows of a table stand alone. Of a page delivered twice, the row with the smallest row_id is kept.
        """
        rows = self.rows.select("origin", "row_id", "path", "page", "text").where("text IS NOT NULL")
        mine = rows.join(self.edits(), ["origin", "row_id"], "left").select("origin", "row_id", "path", "page", "text", "edits")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                block = []
                for origin, row, path, page, text, edits in zip(*(c.to_pylist() for c in b.columns)):
                    paras = reflowed(text, edits or ())
                    for k, (t, open_, closed) in enumerate(paras):
                        block.append((origin, row, path, page, k, t, open_, closed, k == 0, k == len(paras) - 1))
                yield _batch(block, _PARAGRAPH)

        schema = "origin string, row_id long, path string, page int, para int, text string, open boolean, closed boolean, first boolean, last boolean"
        paras = written(mine.mapInArrow(run, schema), "paragraphs")
        edge = F.col("page").isNotNull() & F.col("path").isNotNull() & (F.col("first") | F.col("last"))
        out = ["origin", "path", "row_id", "page", "paragraph", "text"]
        inner = paras.where(~edge).select("origin", "path", "row_id", "page", F.col("para").alias("paragraph"), "text")
        key = ["origin", "path", "page"]
        edges = paras.where(edge)
        before = edges.where("last").select("origin", "path", (F.col("page") + 1).alias("page"), F.col("closed").alias("ended"))
        goes_on = F.col("first") & ~F.coalesce("ended", F.lit(True)) & ~F.col("text").rlike(r"^(Article|ANNEXE) ")
        edges = edges.join(before, key, "left").select(
            F.concat_ws("\u0001", "origin", "path").alias("file"), (F.col("page").cast("long") * 2**24 + F.col("para")).alias("at"), (~goes_on).cast("int").alias("starts"), "origin", "path", "row_id", "page", "para", "text", "open")
        chained = running_sum(edges, "file", "at", "starts", "chain", hot_keys(paras.where(edge).select(F.concat_ws("\u0001", "origin", "path").alias("file")), "file"))
        whole = chained.groupBy("file", "chain").agg(F.min(F.struct("at", "origin", "path", "row_id", "page", "para")).alias("s"), F.array_sort(F.collect_list(F.struct("at", "text", "open"))).alias("t"))
        glued = F.aggregate("t", F.lit(""), lambda acc, p: F.concat(acc, p.text, F.when(p.open, F.lit("")).otherwise(F.lit(" "))))
        return inner.unionByName(whole.select("s.origin", "s.path", "s.row_id", "s.page", F.col("s.para").alias("paragraph"), F.rtrim(glued).alias("text")).select(*out))


_PARAGRAPH = "origin row_id path page para text open closed first last"
_TYPES |= {"para": pa.int32(), "open": pa.bool_(), "closed": pa.bool_(), "first": pa.bool_(), "last": pa.bool_()}
#: What the first two characters of a table's row may be.
_TABLE_BEGINS = frozenset("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZl")


def reflowed(text: str, edits: Iterable[dict]) -> list[tuple[str, bool, bool]]:
    """(paragraph, open, closed) of a row: without furniture, with misread characters put right, words joined that were
    broken at a line's end, and lines joined to paragraphs at blank lines. open: it ends inside a broken word;
    closed: nothing can follow it, because it ends like a sentence or is a row of a table."""
    lines = text.split("\n")
    drop, broken, words, joined = set(), {}, {}, {}
    for e in edits:
        at = (e["line_no"] or 0) - 1
        if e["kind"] == "twice":
            return []
        if e["kind"] == "furniture":
            drop.add(at)
        elif e["kind"] == "hyphen":
            broken[at] = None if e["next_line"] is None else e["next_line"] - 1
        else:
            (words if e["next_line"] is None else joined).setdefault(at, {})[e["read"]] = e["true"]

    # Most texts have no digit or sign where none can stand: one look tells.
    signs, mixed = bool(_INSIDE.search(text.lower())), bool(_DIGIT_BESIDE.search(text))

    def right(part: str, known: dict[str, str]) -> str:
        if not known and not signs and not mixed:
            return part

        def word(m: re.Match) -> str:
            w = m.group(0)
            true = known.get(w.lower())
            return restored(w, true) if true else likely(w) if _INSIDE.search(w.lower()) else w

        part = _WORD.sub(word, part) if known or signs and _INSIDE.search(part.lower()) else part
        number = lambda m: numeric(m.group(0)) if any(c.isdigit() for c in m.group(0)) else m.group(0)
        return _MIXED.sub(number, part) if mixed and _DIGIT_BESIDE.search(part) else part

    out: list[list] = [["", False, False]]
    eaten: dict[int, int] = {}
    for i, line in enumerate(lines):
        if i in drop:
            continue
        if not line or line.isspace():
            out.append(["", False, False])
            continue
        start = eaten.get(i, 0)
        if start and not line[start:].strip():
            continue  # all of it belongs to the word of the line before
        begins = line.lstrip()[:2]
        if (begins[0] in _TABLE_BEGINS and (len(begins) < 2 or begins[1] in _TABLE_BEGINS or begins[1].isspace() or begins[1] in "er")) and (_TABLE.match(line) or _BARE.fullmatch(line)):
            out.append([" ".join(right(line, words.get(i, {})).split()), False, True])
            out.append(["", False, False])
            continue
        tail, open_ = "", False
        body = line[start:]
        if i in broken and (m := _BREAK.search(body)):
            body, open_ = body[: m.start(2)], True
            head = re.search(r"[\w@(]+\Z", body)
            nxt = broken[i]
            rest = re.match(r"\s*(\S+)", lines[nxt]) if nxt is not None else None
            if head and rest:
                core = re.match(r"[\w@(]+", rest.group(1))
                whole = head.group(0) + (core.group(0) if core else "")
                tail = right(whole, joined.get(i, {})) + rest.group(1)[core.end() if core else 0 :]
                body, open_ = body[: head.start()], False
                eaten[nxt] = rest.end()
        spaced = " " if tail and body[-1:].isspace() and not body.isspace() else ""
        body = " ".join(right(body, words.get(i, {})).split()) + spaced + tail
        last = out[-1]
        glue = "" if not last[0] or last[1] or last[0][-1] == "-" and last[0][-2:-1].isalpha() else " "
        last[0], last[1] = last[0] + glue + body, open_
    return [(t, o, c or not o and t.rstrip('»"”)] ')[-1:] in (".", "!", "?", ":", "…")) for t, o, c in out if t]


def project_rows(spark: SparkSession, sf: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf}/doc_pages.parquet").select(F.lit("doc_pages").alias("origin"), F.col("page_id").alias("row_id"), F.col("source_path").alias("path"), F.coalesce("page_num", F.lit(0)).alias("page"), "text")
    chunks = spark.read.parquet(f"{sf}/chunks.parquet").select(F.lit("chunks").alias("origin"), F.col("chunk_ord").alias("row_id"), F.col("source_path").alias("path"), F.lit(None).cast("int").alias("page"), F.col("content").alias("text"))
    return pages.unionByName(chunks)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of pages and chunks with furniture, broken words or misread characters."""
    return Noise(project_rows(spark, sf)).found().select("origin", "row_id", F.col("line_no").cast("int"), "kind")


def p1_repaired(spark: SparkSession, sf: str) -> DataFrame:
    """The paragraphs of all pages and chunks as their authors wrote them."""
    return Noise(project_rows(spark, sf)).paragraphs()


QUERIES = {"p1_found": p1_found, "p1_repaired": p1_repaired}
ORACLE: dict[str, str] = {}
