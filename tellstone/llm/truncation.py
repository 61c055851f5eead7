"""Problem 10: texts that were cut off by a field limit or in transfer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tellstone.session import Scratch
from tellstone.sources.tables import read_table

#: Quotation marks and brackets, which may stand around the mark that ends a sentence.
CLOSERS = r"[\"'”“„’‘»«›‹()\[\]\p{Cf}\p{Cc}]"
#: A text is finished if at least so many of the places with its last token, or such a mark, have a sentence begin after them.
ENDS_SENTENCE = 0.5
#: Weight of what is known of the mark alone against the places of the token itself.
MARK_WEIGHT = 3
#: Texts of one source and length, at least half of them unfinished, that make the length a limit.
LIMIT_TEXTS = 2
# tokens that end in a mark, one after another in a line, and the token that follows them
_MARKED_RUN = r"(?<![^ \n\r\t])(?:[^ \n\r\t]++(?<=[^\p{L}\p{N}]) ++)+[^ \n\r\t]++"


def bare_end(text: Column) -> Column:
    """Text without blanks, invisible characters and markup at its end; only text that ends in such is searched for them."""
    gone = r"[\s\p{Z}\p{Cf}\p{Cc}]"
    bare = F.regexp_replace(text, rf"(?<!{gone})(?:{gone}++|<[^<>]*>|&nbsp;)++$", "")
    return F.when(F.right(text, F.lit(1)).rlike(r"[\s\p{Z}\p{Cf}\p{Cc}>;]"), bare).otherwise(text)


def last_block(body: Column) -> Column:
    """What follows the last line break; texts wrapped into one line have two blanks or more for an empty line."""
    return F.substring_index(F.regexp_replace(F.substring_index(body, "\n", -1), r"[\r\u2028\u2029]|[\s\p{Z}]{2,}", "\n"), "\n", -1)


def core_of(token: Column) -> Column:
    """A token without punctuation around it."""
    return F.regexp_replace(F.regexp_replace(token, r"^[^\p{L}\p{N}]+", ""), r"(?<=[\p{L}\p{N}])[^\p{L}\p{N}]+$", "")


def closing_line(block: Column) -> Column:
    """The state, signature or subjects that close a text, from their sign on, or empty."""
    found = F.regexp_extract(block, r"(?:^|\s)(\$\s[^$]*|—\s\p{Lu}[^\s—]*(?:\s[^\s—.!?]+){0,4}|#\s\p{Lu}[^#.!?]*)$", 1)
    has = F.contains(block, F.lit("$")) | F.contains(block, F.lit("—")) | F.contains(block, F.lit("#"))
    return F.when(has, found).otherwise("")


def closed_up(block: Column) -> Column:
    """A block whose last marks, if they stand by themselves (as after French sentences), follow the word before."""
    return F.regexp_replace(block, r"[\s\p{Z}]+([\"'”“’»›?!]+)$", "$1")


def last_token(block: Column) -> Column:
    return F.substring_index(F.regexp_replace(block, r"[\s\p{Z}]", " "), " ", -1)


def ending_key(token: Column) -> Column:
    """A token as sentence ends are counted for it: without quotation marks and brackets, and with 0 for every digit."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(token, CLOSERS, ""), r"^[^\p{L}\p{N}]+(?=[\p{L}\p{N}])", ""), r"\p{Nd}", "0")


def mark_of(key: Column) -> Column:
    """What follows the last letter or digit."""
    return F.regexp_extract(key, r"([^\p{L}\p{N}]*)$", 1)


def sentence_ends(body: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From all texts (column ``body``), for tokens that end in a mark and for the marks: how often another token follows in the line, and how often it begins a sentence.

    (key, n, n_start) and (mark, mark_share). A token in capitals begins a sentence, unless it is an abbreviation. Abbreviations
    are tokens after which sentences seldom begin (found first with all capitals counted, then again); commas are
    marks after which they don't; signs of omission are marks that nothing ever follows. Tokens without letters say nothing.
    """
    scratch = Scratch(body.sparkSession, "sentence-ends")
    runs = body.where("body <> ''").select(F.explode(F.regexp_extract_all("body", F.lit(_MARKED_RUN), F.lit(0))).alias("run")).groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    tokens = F.split(F.regexp_replace("run", " +", " "), " ", -1)
    loose = lambda t: t.rlike(r"^[\"'”“’»›?!]+$")  # noqa: E731  (marks by themselves belong to the token before)
    at = lambda i: F.try_element_at(tokens, i)
    both = F.transform(F.sequence(F.lit(1), F.size(tokens) - 1), lambda i: F.concat(at(i), F.lit(" "), F.when(loose(at(i + 1)), at(i + 2)).otherwise(at(i + 1))))
    pairs = runs.select(F.explode(F.array_compact(both)).alias("pair"), "n")
    key, after = ending_key(F.substring_index("pair", " ", 1)), F.substring_index("pair", " ", -1)
    start = after.rlike(r"^[^\p{L}\p{N}]*\p{Lu}")
    counts = pairs.select(key.alias("key"), start.alias("start"), F.when(start & (mark_of(ending_key(after)) != ""), ending_key(after)).otherwise("").alias("next"), "n").where(F.col("key").rlike(r"\p{L}") & (mark_of(F.col("key")) != ""))
    counts = scratch.write(counts.groupBy("key", "start", "next").agg(F.sum("n").alias("n")))
    starts = lambda ok: F.sum(F.when(ok, F.col("n")).otherwise(0)).alias("n_start")
    first = counts.groupBy("key").agg(F.sum("n").alias("n"), starts(F.col("start")))
    seldom = (F.col("n_start") < ENDS_SENTENCE * F.col("n")) & (F.col("n") >= MARK_WEIGHT)
    short = first.where(seldom).select(F.col("key").alias("next"), F.lit(True).alias("short"))
    tokens = scratch.write(counts.join(short, "next", "left").groupBy("key").agg(F.sum("n").alias("n"), starts(F.col("start") & F.col("short").isNull())))
    return tokens, tokens.where(~seldom).groupBy(mark_of(F.col("key")).alias("mark")).agg((F.sum("n_start") / F.sum("n")).alias("mark_share"))


def unclosed(block: Column) -> Column:
    """Whether a bracket or quotation is open at the end; a quotation counts as open if no other sentence follows the one that it opens with."""
    odd_quotes = (F.length(block) - F.length(F.replace(block, F.lit('"'), F.lit("")))) % 2 == 1
    return (
        block.rlike(r"\([^()]*$")
        | block.rlike(r"«[^».!?]*[.!?]?$")
        | block.rlike(r"„[^“”.!?]*[.!?]?$")
        | block.rlike(r"(?:^|\s)'(?=[\p{Lu}¿¡])[^'.!?]*[.!?]?$")
        | (odd_quotes & block.rlike(r'"[^".!?]*[.!?]?$'))
    )


def numbered_line(block: Column) -> Column:
    """Whether a block is a numbered line of a transliteration, or ends in the number of the next."""
    return block.rlike(r"^\s*\d+'?(?:\.|$)(?:\s|$)")


def bare_number(block: Column) -> Column:
    """Whether a text in one line ends in the number of a line that is missing."""
    return block.rlike(r"(?:[.!?][\"'”“’»›)\]]*|\p{No}|-[^\s\p{Z}]*)\s+\d+'?\.$")


def _stored_tokens(body: Column) -> Column:
    """Tokens of a text but its last, as stored; empty ones may be among them."""
    before = F.left(body, F.length(body) - F.length(last_token(last_block(body))))
    return F.split(before, r"[\s\p{Z}]+", -1)


def truncated(docs: DataFrame, structure: bool = True) -> DataFrame:
    """Every document with ``cut`` (boolean), ``cut_in`` (word, sentence, line or null), ``evidence`` and ``at_limit``.

    ``docs`` has doc_id (unique), text and source. The end of a text, without blanks and markup after it, is judged by what the corpus itself shows:

    * ``trie``: the vocabulary of the corpus as a trie, one row a node (a prefix, and whether words go on
      from it). A final token that is no known word but a proper prefix of known words was cut.
    * ``ending``: the trie's words with the marks that close them. A sentence ends where the last token, or its mark, is one
      after which sentences begin elsewhere in the corpus; which marks end sentences and which tokens are abbreviations is learnt
      (``sentence_ends``). A last token without such an end is a node at which no text ends. A finished round bracket ends a text too.
    * ``length``: a length in characters or bytes that several texts of a source share,
      at least half of them unfinished, is a limit of the source. A sentence that seems
      finished was cut too if its text has such a length and its final token is a proper prefix of known words
      (``DE.`` of ``DE.NA``).
    * ``structure``: an open bracket or quotation, a numbered line of a transliteration, a closing
      line (state, signature, subjects) that longer ones begin with. Without ``structure`` only closing lines are told apart.

    A word counts once a document and form, never in the place where a text may have been cut. The trie
    holds all words, however rare or long, but only nodes that some document ends with (prefixes of the lengths that
    unknown final tokens have), and is joined by shuffle, not sent to
    all tasks. Null, empty and blank texts are not cut; a null source is a source of its own. An
    empty table gives no rows. Repeated texts are judged alike, each for itself.
    """
    scratch = Scratch(docs.sparkSession, "truncation")
    body = docs.select("doc_id", "source", "text", bare_end(F.col("text")).alias("body"))
    ends = body.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.length("text").alias("chars"), F.octet_length("text").alias("bytes"), (F.coalesce("body", F.lit("")) == "").alias("blank"), closed_up(last_block(F.col("body"))).alias("block"))
    token = F.regexp_replace(last_token(F.col("block")), r"(?<=[\p{L}\p{N}])(?:…|\.{3}|�)+$", "")
    # a note in square brackets after the end is not the author's; what stands before it was cut
    note = F.col("block").rlike(r"[^\s\p{Z}][\s\p{Z}]*\[[^\[\]]*\]$")
    before = F.when(note, last_token(F.regexp_replace("block", r"[\s\p{Z}]*\[[^\[\]]*\]$", ""))).otherwise(token)
    ends = scratch.write(
        ends.select(
            "doc_id", "source", "chars", "bytes", "blank", ending_key(last_token(F.col("block"))).alias("key"), core_of(before).alias("final"), closing_line(F.col("block")).alias("closing"), block_open(structure).alias("open_in"),
            (F.col("block").rlike(r"\([^()]*\)[\"'”“’»›]*$") & ~note).alias("bracket"), note.alias("note"),
        )
    )
    tokens, marks = sentence_ends(body)
    # the trie, as far as texts end in it
    stored = body.where("body <> ''").select(F.explode(_stored_tokens(F.col("body"))).alias("token")).distinct()
    known = scratch.write(stored.select(core_of(F.col("token")).alias("word")).where("word <> ''").distinct())
    finals = ends.where("not blank and final <> ''").select(F.col("final").alias("node")).distinct()
    finals = scratch.write(finals.join(known.select(F.col("word").alias("node")), "node", "left_anti"))
    sizes = finals.select(F.length("node").alias("size")).distinct()
    inner = known.join(F.broadcast(sizes), F.col("size") < F.length("word")).select(F.substring(F.col("word"), F.lit(1), F.col("size")).alias("node"))
    trie = scratch.write(finals.join(inner.distinct(), "node", "left_semi"))
    # the same for whole closing lines: one that many longer lines begin with, word by word, stops early
    lines = scratch.write(ends.where("closing like '$%' or closing like '—%'").groupBy("closing").agg(F.count(F.lit(1)).alias("n")))
    spaced = F.split("closing", " ", -1)
    starts = lines.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.size(spaced)), lambda i: F.array_join(F.slice(spaced, F.lit(1), i), " "))).alias("start"), "closing").where("start <> closing")
    starts = starts.groupBy(F.col("start").alias("closing")).agg(F.sum("n").alias("longer"))
    broken = lines.join(starts, "closing").where("longer >= 3 * n").select("closing", F.lit(True).alias("line_broken"))
    # how sure it is that the last token ends a sentence
    placed = ends.withColumn("mark", mark_of(F.col("key"))).join(marks, "mark", "left").join(tokens, "key", "left")
    unseen = F.col("mark").rlike(r"^[.!?。？！．]$").cast("double")  # nothing in the corpus tells: what is a full stop everywhere
    sure = (F.coalesce("n_start", F.lit(0)) + MARK_WEIGHT * F.coalesce("mark_share", unseen)) / (F.coalesce("n", F.lit(0)) + MARK_WEIGHT)
    ended = ((sure >= ENDS_SENTENCE) | F.col("bracket")) & ~F.col("note")
    state = (
        F.when(F.col("blank"), "blank")
        .when(F.col("closing") != "", F.when(F.col("open_in") == "mark", "ending").otherwise("closing"))
        .when(F.col("open_in").isin("line", "unclosed"), F.col("open_in"))
        .when(~ended, "ending")
        .otherwise("finished")
    )
    judged = scratch.write(placed.select("doc_id", "source", "chars", "bytes", "final", "closing", state.alias("state")))
    is_open = F.col("state").isin("line", "unclosed", "ending")
    joined = judged.join(trie.select(F.col("node").alias("final"), F.lit(True).alias("prefix")), "final", "left").join(broken, "closing", "left")
    for unit in ("chars", "bytes"):
        part = judged.where("state <> 'blank'").groupBy("source", unit).agg(F.count(F.lit(1)).alias("n"), F.count_if(is_open).alias("n_open")).where(f"n >= {LIMIT_TEXTS} and 2 * n_open >= n")
        joined = joined.join(part.select("source", unit, F.lit(True).alias(f"limit_{unit}")), ["source", unit], "left")
    prefix, at_limit = F.coalesce("prefix", F.lit(False)), F.coalesce("limit_chars", "limit_bytes", F.lit(False))
    told = lambda where, by: F.struct(F.lit(where).alias("cut_in"), by.alias("evidence"))
    found = (
        F.when(F.col("state") == "blank", None)
        .when(F.col("state") == "line", told("line", F.lit("structure")))
        .when(is_open & prefix, told("word", F.lit("trie")))
        .when(is_open, told("sentence", F.when(F.col("state") == "unclosed", "structure").otherwise("ending")))
        .when((F.col("state") == "closing") & prefix, told("word", F.lit("trie")))
        .when((F.col("state") == "closing") & F.col("line_broken"), told("sentence", F.lit("structure")))
        .when((F.col("state") == "finished") & at_limit & prefix, told("word", F.lit("length")))
    )
    out = joined.select("doc_id", F.nullif("source", F.lit("")).alias("source"), found.alias("found"), (at_limit & (F.col("state") != "blank")).alias("at_limit"))
    return out.select("doc_id", "source", F.col("found").isNotNull().alias("cut"), "found.cut_in", "found.evidence", "at_limit")


def block_open(structure: bool) -> Column:
    """What is open in a block: a line, a bracket or quotation, a mark after which more must follow; null for nothing."""
    block = F.col("block")
    more = F.when(block.rlike(r"[;,:\-]$"), "mark")
    if not structure:
        return more
    return F.when(numbered_line(block), "line").when(unclosed(block) | bare_number(block), F.when(closing_line(block) == "", "unclosed").otherwise(more)).otherwise(more)


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncated(read_table(spark, folder, "documents", "doc_id", "text", "source")).where("cut").select("doc_id")


def p10_rates(spark: SparkSession, folder: str) -> DataFrame:
    """For each source: documents, those cut, the share, and those cut at a limit of the source."""
    judged = truncated(read_table(spark, folder, "documents", "doc_id", "text", "source"))
    return judged.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.count_if("cut").alias("n_cut"), F.round(F.count_if("cut") / F.count(F.lit(1)), 6).alias("share"), F.count_if(F.col("cut") & F.col("at_limit")).alias("n_cut_at_limit")
    )


def p10_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """For every document that was cut, in what and what tells."""
    return truncated(read_table(spark, folder, "documents", "doc_id", "text", "source")).where("cut").select("doc_id", "cut_in", "evidence", "at_limit")


QUERIES = {"p10_found": p10_found, "p10_rates": p10_rates, "p10_evidence": p10_evidence}
SQL: dict[str, str] = {}
