"""Assembly of prompts, options, payloads and displayed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lekha.functions.text import DEVANAGARI


def english_lines(raw: Column) -> Column:
    """Readable text of a JSON object of strings: a line per member, as "key) value"
    for one-letter keys, values that begin in Devanagari left out."""
    entries = F.map_entries(F.from_json(raw, "map<string,string>"))
    kept = F.filter(entries, lambda e: e["value"].isNotNull() & ~F.substring(e["value"], 1, 20).rlike(DEVANAGARI))
    lines = F.transform(kept, lambda e: F.when(F.length(e["key"]) == 1, F.concat(F.upper(e["key"]), F.lit(") "), e["value"])).otherwise(e["value"]))
    return F.array_join(F.array_sort(lines), "\n")


def record_block(parts: list[Column]) -> Column:
    """Parts that are not blank, with an empty line between them."""
    return F.concat_ws("\n\n", *[F.nullif(F.trim(p), F.lit("")) for p in parts])


def choice_prompt(question: Column, options: Column) -> Column:
    """Question, options by letter, and the call for an answer. ``options`` is a map."""
    lines = F.transform(F.array_sort(F.map_entries(options)), lambda e: F.concat(F.upper(e["key"]), F.lit(". "), e["value"]))
    return F.concat(question, F.lit("\n"), F.array_join(lines, "\n"), F.lit("\nAnswer:"))


def after_front_matter(text: Column) -> Column:
    """Text after the first line that is only dashes; all of it without one."""
    at = F.regexp_instr(F.concat(F.lit("\n"), text), F.lit(r"\n---[ \t]*\n"))
    rest = F.regexp_replace(F.substr(F.concat(F.lit("\n"), text), at + 1, F.length(text) + 1), r"^---[ \t]*\n", "")
    return F.when(at > 0, rest).otherwise(text)


def input_payload(task: Column, gold: Column) -> Column:
    """The task's input as JSON text, out of its gold payload, with defaults."""
    g = lambda f: F.get_json_object(gold, f"$.{f}")
    words = F.coalesce(F.nullif(g("word_count").cast("int"), F.lit(0)), F.lit(250))
    most = F.coalesce(g("max_score").cast("double"), F.lit(15.0))
    return F.when(task.isin("A", "F"), F.to_json(F.struct(g("question").alias("question")))).when(task.isin("B", "G"), F.to_json(F.struct(g("question").alias("question"), words.alias("word_count"), most.alias("max_score")))).when(task == "C", F.to_json(F.struct(g("question_text").alias("question_text"), g("answer_text").alias("answer_text"), most.alias("max_score")))).otherwise(F.to_json(F.struct(g("title").alias("title"), g("source_text").alias("article"))))


def percent(x: Column, digits: int = 1) -> Column:
    return F.when(x.isNull() | F.isnan(x), F.lit("-")).otherwise(F.concat(F.format_string(f"%.{digits}f", x * 100), F.lit("%")))


def signed(x: Column, digits: int = 3) -> Column:
    return F.when(x.isNull() | F.isnan(x), F.lit("-")).otherwise(F.format_string(f"%+.{digits}f", x))


def p_value(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x), F.lit("-")).when(x < 1e-3, F.format_string("%.1e", x)).otherwise(F.format_string("%.3f", x))


def with_interval(mean: Column, lo: Column, hi: Column) -> Column:
    return F.when(mean.isNull(), F.lit("-")).otherwise(F.format_string("%.3f [%.3f, %.3f]", mean, lo, hi))


def dimensions(text: Column, lexicon: dict[str, tuple[str, ...]]) -> Column:
    """Names of the lexicon's dimensions of which a word stands in the text. A lexicon
    is a setting of a few hundred words, so it is part of the expression."""
    lower = F.lower(text)
    hits = [F.when(lower.rlike(f"(^|[^a-z0-9_])({'|'.join(ws)})([^a-z0-9_]|$)"), F.lit(name)) for name, ws in sorted(lexicon.items())]
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def strongest_dimension(text: Column, lexicon: dict[str, tuple[str, ...]]) -> Column:
    """The dimension with most words in the text, of ties the first by name."""
    lower = F.lower(text)
    counts = F.array(*[F.struct((-F.size(F.regexp_extract_all(F.regexp_replace(lower, "([^a-z0-9_])", "$1$1"), F.lit(f"(?:^|[^a-z0-9_])(?:{'|'.join(ws)})(?:[^a-z0-9_]|$)"), F.lit(0)))).alias("n"), F.lit(name).alias("d")) for name, ws in sorted(lexicon.items())])
    return F.array_min(counts)["d"]


def distractors_cited(explanation: Column, options: Column, correct: Column, common: tuple[str, ...], most: int = 5) -> Column:
    """Share of the wrong options A to D that an explanation names by letter and
    shares one of the first ``most`` telling words with. ``options`` is a map with
    upper-case keys."""
    lower = F.lower(explanation)
    wrong = F.filter(F.map_entries(options), lambda e: F.array_contains(F.array(*[F.lit(x) for x in "ABCD"]), e["key"]) & (e["key"] != F.upper(correct)))

    def cited(e: Column) -> Column:
        k = F.lower(e["key"])
        named = F.regexp_like(lower, F.concat(F.lit(r"(^|[^a-z0-9_])option[ \t\n]+"), k, F.lit(r"([^a-z0-9_]|$)|\([ \t\n]*"), k, F.lit(r"[ \t\n]*\)|(^|[^a-z0-9_])"), k, F.lit(r"\)")))
        tokens = F.filter(F.regexp_extract_all(F.lower(e["value"]), F.lit(r"[a-z\x{0900}-\x{097F}]+"), F.lit(0)), lambda w: (F.length(w) > 3) & ~w.isin(*common))
        return named & F.exists(F.slice(tokens, 1, most), lambda w: F.contains(lower, w))

    return F.when((F.size(wrong) > 0) & (explanation != ""), F.size(F.filter(wrong, cited)) / F.size(wrong)).otherwise(0.0)
