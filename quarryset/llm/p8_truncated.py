"""Texts cut off by field limits or mid-transfer.

1. `ending` reads the end of each whole text with a small automaton: it strips what a cut may
   leave behind (marks of omission, halves of characters, entities, tags, addresses), keeps a
   stack of quotes and brackets over the last paragraph, and tells whether a sentence is open.
2. Statistics over all documents say what such an end means: lines that come back in different
   surroundings are elements of the page (menus, notices, footers); words that hardly ever stand
   before a full stop cannot end a sentence; lengths at which a source's open texts pile up (in
   characters or bytes) are its field limits.
3. A text is cut if its last paragraph is running prose that stays open, and the baseline of its
   source, its brackets, what was left behind, or its last word confirms it.

All statistics are counts that add up over batches, so each pass is one scan and an aggregation
of narrow rows. Null, empty and blank texts are never cut.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryset.runtime import Scratch

#: Surroundings that make a line an element; share and number of sentence ends that let a word end
#: one; width and least weight of a pile of lengths.
CONTEXTS, FINAL_SHARE, FINAL_LEAST, PILE, PILE_SHARE, PILE_LEAST = 3, 0.05, 2, 16, 0.01, 3
_END = ".!?。！？"
_OPEN, _CLOSE = "(“„«[{「", ")”“»]}」"
_PAIR = {"”": "“„", "“": "„", "»": "«", ")": "(", "]": "[", "}": "{", "」": "「"}
_INVISIBLE = regex.compile(r"[\s\p{Cf}\x00-\x1f\x7f]+$")
_OMISSION = regex.compile(r"(?:…|\.\.\.+|â€¦|\[…\]|\[\.\.\.\])$")
_BROKEN = regex.compile(r"�+$|\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?$|%[0-9A-F]?$")
_ENTITY = regex.compile(r"&(?:amp;)?(?:#x?[0-9a-fA-F]{0,6}|[a-zA-Z]{0,8})$")
_TAG = regex.compile(r"<[/!]?[a-zA-Z]{0,10}(?:\s[^<>\n]{0,200})?$")
_ADDRESS = regex.compile(r"(?<=\S)\s+(?:https?:/{0,2}[^\s/]*|www\.?[^\s.]*|[\w.+-]+@[^\s.]*)$")
_LABEL = regex.compile(r"^\p{L}{2,14}(?: \p{L}{2,14})?:\s")
_CLOSED = regex.compile(rf"[{_END}][\"'”“»」)\]]*$")
_INNER = regex.compile(r"(?<=[\p{L}\p{N})\"”][.!?])\s+(?=[\"“(«]?\p{Lu})|(?<=[。！？])(?=\S)")
_LIST = regex.compile(r"^(?:\(?\d{1,3}[.)]\s|[-*•·›»>|#+]|[—–]\s*\S)")
_NOT_PROSE = regex.compile(r"[|·•{}=;<>*_\\@\t©]|https?:|^\P{L}*\d+\s*/\s*\d+\W*$|^\W*\S{0,3}\s?(?:19|20)\d\d\s+\S+(?:\s+\S+){0,5}$")
_CONTACT = regex.compile(r"(?:@|https?:|www\.)\S*\W*$")
_LETTERS = regex.compile(r"[\p{L}\p{M}\s,'’.!?:-]")
_DIGITS = regex.compile(r"\d+")
_UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]$")
_TOKEN = regex.compile(r"[\p{L}\p{M}\p{N}'’-]+(?:[\"'”»)]*[.!?。！？])?")


def repaired(line: str) -> str:
    """A line whose UTF-8 bytes were read under another charset, as it was meant."""
    if not line.isascii():
        for charset in ("latin-1", "cp1252", "cp1251"):
            try:
                return line.encode(charset).decode("utf-8")
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
    return line


def pattern(line: str) -> int:
    """Key of a line up to its numbers."""
    return xxhash.xxh64_intdigest(_DIGITS.sub("#", line)) - (1 << 63)


def token(word: str) -> str:
    """What the word statistics count: the word, or the last two signs where no spaces divide words."""
    return word[-2:] if _UNSPACED.search(word) else word


def unclosed(block: str) -> bool:
    """True if a quote or bracket opened in a block isn't closed in it, by a stack automaton.

    A straight double quote closes the one on top of the stack or else opens one; after a digit it
    is a measure. A closing sign that nothing opened is ignored, and so is what it would have closed
    further down."""
    stack: list[str] = []
    for i, c in enumerate(block):
        if c == '"':
            if stack and stack[-1] == c:
                stack.pop()
            elif not (i and block[i - 1].isdigit()):
                stack.append(c)
        elif stack and c in _CLOSE and stack[-1] in _PAIR.get(c, ""):
            stack.pop()
        elif c in _OPEN:
            stack.append(c)
    return bool(stack)


def ending(text: str | None) -> tuple[str, str, str]:
    """(state, last line as it stands, last word).

    States: `none` (nothing to cut), `closed`, `element` (list, address, sign-off, code),
    `bracket` (open, and a quote or bracket too: the stack isn't empty), `marked` (open, with a
    remnant or mark of omission), `several` (open, after whole sentences in the same paragraph),
    `single`.
    """
    rest = _INVISIBLE.sub("", text or "")
    if not rest:
        return "none", "", ""
    cut = max(rest.rfind("\n"), rest.rfind("\r"))
    line = rest[cut + 1 :].strip()
    whole, line, marked = line, repaired(line), False
    while True:
        for find in (_OMISSION, _BROKEN, _ENTITY, _TAG, _ADDRESS):
            m = find.search(line)
            if m and m.start() > 0:
                # a sign that stands alone after a whole sentence leaves that sentence whole
                line, marked = _INVISIBLE.sub("", line[: m.start()]), True
                break
        else:
            break
    if not line:
        return "element", whole, ""
    if _CLOSED.search(line):
        return "closed", whole, ""
    letters = sum(1 for _ in _LETTERS.finditer(line))
    several = _INNER.search(line) is not None
    # signs of markup within several sentences of prose are remnants, not an element of the page
    signs = _NOT_PROSE.search(line) is not None and not (several and letters >= 0.94 * len(line) and not _CONTACT.search(line))
    if _LIST.search(line) or signs or letters < 0.76 * len(line) or not regex.search(r"\p{L}", line):
        return "element", whole, ""
    if regex.search(r"[^\p{L}\p{M}\p{N}\s,;:'’–—(“„«%$€-]$", line):
        return "element", whole, ""  # ends in a sign that no sentence breaks off at
    words = _TOKEN.findall(line)
    last = token(words[-1]) if words else ""
    if _LABEL.search(line) and not several and not marked:
        return "element", whole, ""  # a teaser: a label and what it leads to
    state = "bracket" if unclosed(line) else "marked" if marked else "several" if several else "single"
    return state, whole, last


FEATURES = "doc_id bigint, source string, chars bigint, bytes bigint, state string, line bigint, word string, symbols boolean, comma boolean"


def features(docs: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            rows = []
            for doc, source, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                state, line, word = ending(text)
                comma = line.endswith((",", ":", "-", "'", "’", "(", "“", "„", "«"))
                rows.append((doc, source or "", len(text or ""), len((text or "").encode("utf-8", "replace")), state, pattern(line), word, regex.search(r"[^\p{L}\s,']", line) is not None, comma))
            if rows:
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in FEATURES.split(", ")])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("source").cast("string"), F.col("text").cast("string")).mapInArrow(run, FEATURES)


def statistics(docs: DataFrame) -> DataFrame:
    """Counts over all whole texts: (kind, key, word, a, b, n).

    `line`: key a line's pattern, a the lines before it, b 1 if it isn't the text's last line. The
    n of all rows of a pattern add up to how often it occurs.
    `word`: how often the word stands in a text (a), and before a mark that ends a sentence (b).
    Equal rows of a batch are added up, and a line's surroundings are kept up to the number that
    decides, before anything is sent.
    """

    def run(batches):
        words: Counter[str] = Counter()
        final: Counter[str] = Counter()
        seen: dict[tuple[int, int], set[int]] = {}
        times: Counter[tuple[int, int]] = Counter()

        def flush():
            rows = [("line", k, None, before, inner, 0 if i else times[k, inner]) for (k, inner), many in seen.items() for i, before in enumerate(many)]
            rows += [("word", None, w, n, final.get(w, 0), 0) for w, n in words.items()]
            words.clear(), final.clear(), seen.clear(), times.clear()
            for s in range(0, len(rows), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[s : s + 50_000], strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["kind", "key", "word", "a", "b", "n"])

        for b in batches:
            for text in b.column(0).to_pylist():
                if not text:
                    continue
                counts = Counter(_TOKEN.findall(text))
                for t, n in counts.items():
                    end = t[-1] in _END
                    w = token(t.rstrip(_END + "\"'”»)")) if end else token(t)
                    words[w] += n
                    if end:
                        final[w] += n
                lines = [x for x in (p.strip() for p in text.splitlines()) if x]
                for i, x in enumerate(lines):
                    if not _LIST.search(x):
                        at = pattern(x), int(i + 1 < len(lines))
                        times[at] += 1
                        many = seen.setdefault(at, set())
                        if len(many) < CONTEXTS:
                            # three lines, so that a footer of several lines reaches up into the text
                            many.add(pattern("\n".join(lines[max(0, i - 3) : i])))
            if len(words) + len(seen) > 300_000:
                yield from flush()
        yield from flush()

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "kind string, key bigint, word string, a bigint, b bigint, n bigint")


def truncated(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, source, cut) of all documents; a null source counts as the source ''."""
    seen = scratch.write(features(docs), "features")
    stats = scratch.write(statistics(docs).groupBy("kind", "key", "word", F.when(F.col("kind") == "line", F.col("a")).alias("_c"), F.when(F.col("kind") == "line", F.col("b")).alias("inner")).agg(F.sum(F.when(F.col("kind") == "word", F.col("a"))).alias("a"), F.sum(F.when(F.col("kind") == "word", F.col("b"))).alias("b"), F.sum("n").alias("n")), "statistics")
    lines = stats.filter("kind = 'line'").groupBy("key").agg(F.countDistinct(F.when(F.col("inner") == 1, F.col("_c"))).alias("_inner"), F.countDistinct("_c").alias("_all"), F.sum("n").alias("_times")).filter(f"_inner >= 2 or _all >= {CONTEXTS}").select(F.col("key").alias("line"), "_inner", "_all", "_times")
    words = stats.filter("kind = 'word'").select("word", F.col("a").alias("_n"), F.col("b").alias("_final"))
    opens = "state in ('several', 'marked', 'bracket', 'single', 'element')"
    size = seen.groupBy("source").agg(F.max("chars").alias("_mc"), F.max("bytes").alias("_mb"))
    piles = (
        seen.join(size, "source")
        .groupBy("source", "_mc", "_mb")
        .agg(F.count(F.lit(1)).alias("_docs"), F.count_if(F.expr(f"{opens} and chars > _mc - {PILE}")).alias("_pc"), F.count_if(F.expr(f"{opens} and bytes > _mb - {PILE}")).alias("_pb"))
        .select("source", "_mc", "_mb", F.expr(f"_pc >= {PILE_LEAST} and _pc >= {PILE_SHARE} * _docs").alias("_lc"), F.expr(f"_pb >= {PILE_LEAST} and _pb >= {PILE_SHARE} * _docs").alias("_lb"))
    )
    return (
        seen.join(piles, "source", "left")
        .join(lines, "line", "left")
        .join(words, "word", "left")
        .withColumn("_limit", F.expr(f"coalesce((_lc and chars > _mc - {PILE}) or (_lb and bytes > _mb - {PILE}), false)"))
        .withColumn("_element", F.expr(f"coalesce(_inner >= 2 or (_all >= {CONTEXTS} and (symbols and not _limit or _n <= 4 * _times)), false)"))
        .withColumn("_can_end", F.expr(f"coalesce(_final >= {FINAL_LEAST} and _final >= {FINAL_SHARE} * _n, false) and not comma"))
        .withColumn("cut", F.expr("state in ('several', 'marked', 'bracket', 'single') and not _element and (state <> 'single' or _limit or not _can_end)"))
        .select("doc_id", "source", "cut", "state", "_limit", "_element", "_can_end")
    )


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return truncated(_docs(spark, sf), Scratch(spark, "p8")).filter("cut").select("doc_id").distinct()


def p8_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Documents, cut documents and their share, for each source."""
    t = truncated(_docs(spark, sf), Scratch(spark, "p8"))
    return t.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count_if("cut").alias("cut"), F.round(F.avg(F.col("cut").cast("double")), 6).alias("share"))
