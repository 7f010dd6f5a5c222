"""Visually identical text with different characters (problem 5): one consistent spelling.

Characters are mapped one by one, then values that are equal under an accent-sensitive Unicode
collation form a class, and the class's most frequent clean member is written for all of them.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lutrin.plans.scale import written

#: Distinct words that a worker counts before it hands them on.
FLUSH = 200_000

# Letters of other scripts and the Latin letters they pass for.
CYRILLIC = dict(zip("асԁеһіјӏоԛрѕԝхуѵАВЕЅІЈКМНОРСТХУԌԚԜ", "acdehijloqpswxyvABESIJKMHOPCTXYGQW"))
GREEK = dict(zip("αινορυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aivopuABEZHIKMNOPTYX"))
# Characters without width, and spaces other than U+0020.
ZERO_WIDTH = "\u180e\u200b\u200c\u200d\u200e\u200f\u2060\u2061\u2062\u2063\u2064\ufeff"
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
# Combining accents that French, and other languages in Latin letters, put on letters.
ACCENTS = "\u0300\u0301\u0302\u0303\u0304\u0306\u0307\u0308\u030a\u030b\u030c\u0323\u0327\u0328"


def _one_to_one() -> dict[str, str]:
    full = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    return full | CYRILLIC | GREEK | {c: " " for c in SPACES} | {"￠": "¢", "￡": "£", "￥": "¥"}


def _one_to_many() -> dict[str, str]:
    """Latin ligatures and Roman numerals in one character, by their Unicode decomposition."""
    return {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in (*range(0xFB00, 0xFB07), *range(0x2160, 0x2180))}


def _composed() -> dict[str, str]:
    """Letter and accent to the composed letter, by Unicode composition."""
    letters = [chr(c) for c in (*range(0x41, 0x5B), *range(0x61, 0x7B))]
    pairs = {x + a: unicodedata.normalize("NFC", x + a) for x in letters for a in ACCENTS}
    return {d: c for d, c in pairs.items() if len(c) == 1}


ONE, MANY, PAIRS = _one_to_one(), _one_to_many(), _composed()


def _ranges(chars: str) -> str:
    """A character class in as few ranges as possible."""
    points, out = sorted(set(map(ord, chars))), []
    for p in points:
        if out and p == out[-1][1] + 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out) + "]"


SUSPECT = _ranges("".join((*ONE, *MANY)) + ZERO_WIDTH + "".join(map(chr, range(0x300, 0x370))))
#: One wide range that holds all of them: most texts have no character in it and need no closer look.
WIDE = r"[\x{a0}\x{300}-\x{ffff}]"


def suspect(value: Column) -> Column:
    """Whether a value holds any character that the mapping replaces."""
    return value.rlike(WIDE) & value.rlike(SUSPECT)


def _mapped(value: Column, table: dict[str, str], cut: str) -> Column:
    """value with the parts between zero-width matches of `cut` replaced where the table has them."""
    lookup = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.array_join(F.transform(F.split(value, cut), lambda part: F.coalesce(F.try_element_at(lookup, part), part)), "")


def fold(value: Column) -> Column:
    """The value in plain characters; composed accents, œ, superscripts, bullets, dashes, ¬ and λ stay.

    A combining accent that no letter takes is dropped.
    """
    plain = F.translate(value, "".join(ONE) + ZERO_WIDTH, "".join(ONE.values()))
    many = "[" + "".join(MANY) + "]"
    plain = F.when(plain.rlike(many), _mapped(plain, MANY, f"(?={many})|(?<={many})")).otherwise(plain)
    mark = r"[\u0300-\u036f]"
    composed = _mapped(plain, PAIRS, f"(?=[A-Za-z]{mark})|(?<={mark})")
    return F.when(plain.rlike(mark), F.regexp_replace(composed, mark, "")).otherwise(plain)


def classes(values: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(value, canonical, members) of distinct values with their counts `n` (columns value, n).

    Values whose folds are equal under the accent-sensitive, case-sensitive UNICODE collation are one
    class; characters that the collation ignores, such as soft hyphens, thus make no difference. Its
    canonical member is the most frequent value that needs no mapping, the smallest in code point order
    among equals; a class without a clean value gets its smallest fold. only: a table of values whose
    classes are wanted; their members are still all values.
    """
    keyed = _keyed(values)
    if only is not None:
        keyed = keyed.join(_keyed(only).select("key").distinct(), "key", "left_semi")
    picked = keyed.groupBy("key").agg(
        F.min_by(F.when(F.col("clean"), F.col("value")), F.struct((~F.col("clean")).alias("a"), (-F.col("n")).alias("n"), F.col("value").alias("v"))).alias("member"),
        F.min("fold").alias("least"), F.count(F.lit(1)).alias("members"),
    )
    wanted = keyed if only is None else keyed.join(only.select("value"), "value", "left_semi")
    return wanted.join(picked, "key").select("value", F.coalesce("member", "least").alias("canonical"), "members")


def _keyed(values: DataFrame) -> DataFrame:
    """values with fold, clean and key: the fold's collation key, by which Spark's aggregation and joins group."""
    folded = values.withColumn("fold", F.when(suspect(F.col("value")), fold(F.col("value"))).otherwise(F.col("value")))
    return folded.withColumns({"clean": F.col("value") == F.col("fold"), "key": F.expr("fold COLLATE UNICODE")})


def canonical(rows: DataFrame, record: str, columns: list[str], text: str | None = None) -> DataFrame:
    """(record, field, canonical) of every value that holds a character to be replaced and differs from the
    canonical member of its class.

    A column of names is compared as a whole. The text column is compared word by word, so that no full
    text is shuffled for grouping: words are counted over all rows, each suspect word takes the canonical
    member of its class over the words of the whole collection, and is put back in its place. Null values
    and values in plain characters give no row; empty tables give an empty result. Rows that share a record
    give their rows each.
    """
    out = None
    for c in columns:
        counted = rows.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n"))
        mapped = classes(counted, counted.where(suspect(F.col("value"))))
        part = rows.where(suspect(F.col(c))).select(F.col(record), F.col(c).alias("value")).join(mapped, "value").where("canonical <> value").select(record, F.lit(c).alias("field"), "canonical")
        out = part if out is None else out.unionByName(part)
    if text:
        part = _by_word(rows, record, text)
        out = part if out is None else out.unionByName(part)
    return out


def word_counts(rows: DataFrame, text: str) -> DataFrame:
    """(value, n): the words of all texts, cut at any space and at line feeds, counted before the shuffle."""
    spaces, table = re.compile(f"[{SPACES}]"), dict.fromkeys(map(ord, SPACES), " ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(counts: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["value", "n"])

        counts: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                counts.update((t.translate(table) if spaces.search(t) else t).replace("\n", " ").split(" "))
            if len(counts) > FLUSH:
                yield batch(counts)
                counts = Counter()
        yield batch(counts)

    partial = rows.where(F.col(text).isNotNull()).select(text).mapInArrow(run, "value string, n long")
    return partial.where("value <> ''").groupBy("value").agg(F.sum("n").alias("n"))


def _by_word(rows: DataFrame, record: str, text: str) -> DataFrame:
    # Spaces become U+0020 before the text is cut, so a word never holds one; line feeds stay words' ends.
    spaced = F.translate(F.col("t"), SPACES, " " * len(SPACES))
    pieces = F.regexp_extract_all(spaced, F.lit(r"[^ \n]+|[ \n]+"), F.lit(0))
    dirty = rows.where(suspect(F.col(text))).select(F.col(record), F.col(text).alias("t"), F.monotonically_increasing_id().alias("row"))
    dirty = written(dirty, "dirty")
    odd = dirty.select("row", F.explode(F.array_distinct(F.filter(pieces, suspect))).alias("value"))
    mapped = classes(word_counts(rows, text), odd.select("value").distinct())
    fixes = odd.join(mapped, "value").groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("value", "canonical"))).alias("fixes"))
    fixed = F.array_join(F.transform(pieces, lambda w: F.coalesce(F.try_element_at(F.col("fixes"), w), w)), "")
    new = dirty.join(fixes, "row", "left").select(record, "t", F.lit(text).alias("field"), F.when(F.col("fixes").isNull(), spaced).otherwise(fixed).alias("canonical"))
    return new.where("canonical <> t").select(record, "field", "canonical")


def p5_canonical(spark: SparkSession, sf: str) -> DataFrame:
    """Every path and content that is not in the common spelling, with that spelling."""
    chunks = spark.read.parquet(f"{sf}/chunks.parquet")
    return canonical(chunks, "chunk_ord", ["source_path"], "content")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Paths and contents whose stored characters differ from their canonical spelling."""
    chunks = spark.read.parquet(f"{sf}/chunks.parquet")
    return canonical(chunks, "chunk_ord", ["source_path"], "content").select("chunk_ord", "field").distinct()


def p5_path_members(spark: SparkSession, sf: str) -> DataFrame:
    """Each stored path of chunks with its canonical path and the number of spellings in its class."""
    paths = spark.read.parquet(f"{sf}/chunks.parquet").where("source_path IS NOT NULL").groupBy(F.col("source_path").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return classes(paths).select(F.col("value").alias("source_path"), "canonical", "members")


QUERIES = {"p5_found": p5_found, "p5_canonical": p5_canonical, "p5_path_members": p5_path_members}


def _class(chars: str) -> str:
    return "".join(f"\\x{{{ord(c):X}}}" for c in chars)


def _sql_fold(x: str) -> str:
    """The mapping in SQL: single characters, characters without width, ligatures and numerals, accents."""
    plain = "".join(ONE.values()).replace("'", "''")
    one = f"translate({x}, '{''.join(ONE)}', '{plain}')"
    one = f"regexp_replace({one}, '[{_class(ZERO_WIDTH)}]', '', 'g')"
    for a, b in MANY.items():
        one = f"replace({one}, '{a}', '{b}')"
    return f"regexp_replace(CASE WHEN regexp_matches({one}, '[\\x{{300}}-\\x{{36F}}]') THEN nfc_normalize({one}) ELSE {one} END, '[\\x{{300}}-\\x{{36F}}]', '', 'g')"


def _sql_suspect(x: str) -> str:
    return f"regexp_matches({x}, '[{_class(''.join((*ONE, *MANY)) + ZERO_WIDTH)}\\x{{300}}-\\x{{36F}}]')"


# Characters that the collation passes over.
_KEY = r"regexp_replace(f, '[\x{1}-\x{8}\x{E}-\x{1F}\x{7F}-\x{84}\x{86}-\x{9F}\x{AD}\x{FE00}-\x{FE0F}]', '', 'g')"


def _sql_classes(counts: str) -> str:
    """cl(value, canonical, members) of a table of values and counts n."""
    return f"""
fo AS (SELECT value, n, CASE WHEN {_sql_suspect('value')} THEN {_sql_fold('value')} ELSE value END AS f FROM {counts}),
ke AS (SELECT *, {_KEY} AS k, value = f AS clean FROM fo),
be AS (SELECT k, count(*) AS members, min(f) AS least FROM ke GROUP BY k),
me AS (SELECT DISTINCT ON (k) k, value AS member FROM ke WHERE clean ORDER BY k, n DESC, value),
cl AS (SELECT value, coalesce(member, least) AS canonical, members FROM ke JOIN be USING (k) LEFT JOIN me USING (k))"""


_SPACED = f"translate(content, '{SPACES}', '{' ' * len(SPACES)}')"
ORACLE = {
    "p5_canonical": f"""
WITH pc AS (SELECT source_path AS value, count(*) AS n FROM chunks WHERE source_path IS NOT NULL GROUP BY 1),
{_sql_classes('pc')},
paths AS (SELECT chunk_ord, 'source_path' AS field, canonical FROM chunks JOIN cl ON value = source_path WHERE {_sql_suspect('source_path')}),
wc AS (SELECT value, count(*) AS n FROM (SELECT unnest(regexp_extract_all({_SPACED}, '[^ \\n]+')) AS value FROM chunks) GROUP BY 1),
{_sql_classes('wc').replace('fo ', 'fo2 ').replace('ke ', 'ke2 ').replace('be ', 'be2 ').replace('me ', 'me2 ').replace('cl ', 'cl2 ').replace('FROM fo)', 'FROM fo2)').replace('be USING', 'be2 USING').replace('me USING', 'me2 USING')},
pi AS (SELECT chunk_ord, regexp_extract_all({_SPACED}, '[^ \\n]+|[ \\n]+') AS ps FROM chunks WHERE {_sql_suspect('content')}),
ex AS (SELECT chunk_ord, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM pi),
texts AS (SELECT chunk_ord, 'content' AS field, string_agg(CASE WHEN {_sql_suspect('p')} THEN canonical ELSE p END, '' ORDER BY i) AS canonical FROM ex LEFT JOIN cl2 ON value = p GROUP BY chunk_ord)
SELECT * FROM paths UNION ALL SELECT * FROM texts""",
    "p5_path_members": f"""
WITH pc AS (SELECT source_path AS value, count(*) AS n FROM chunks WHERE source_path IS NOT NULL GROUP BY 1),
{_sql_classes('pc')}
SELECT value AS source_path, canonical, members FROM cl""",
    "p5_found": f"""
WITH v AS (SELECT chunk_ord, 'source_path' AS field, source_path AS x FROM chunks UNION ALL SELECT chunk_ord, 'content', content FROM chunks)
SELECT DISTINCT chunk_ord, field FROM v WHERE {_sql_suspect('x')}""",
}
