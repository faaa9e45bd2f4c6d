"""Column functions for model responses, explanations and free-text numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import strip, white_words

#: Phrases by which a comment leans on another version of the text.
DEPENDENT = ("compared to", "compared with", "original version", "source version", "human version", "ai version", "reference text")
#: Patterns of explanations that name what models do, what people do, or a cause, and of those that only restate a verdict.
MECHANISM = (
    r"(?i)AI\s+(tends?|rarely|never|often|usually|frequently|almost never|is trained|generates?|produces?)",
    r"(?i)LLMs?\s+(tends?|rarely|never|often|generates?|produces?)",
    r"(?i)language models?\s+(tends?|rarely|generates?|produces?|are trained)",
    r"(?i)\btrained\s+(to|on\b|not\s+to)",
    r"(?i)\bfine[- ]?tun(ed|ing)\b",
    r"(?i)(GPT|Claude|Gemini|Grok|LLMs?|models?)\s+(tends?|often|rarely|generates?|produces?|are\s+trained|is\s+trained)",
    r"(?i)(generated|auto-?generated|AI-?generated)\s+text",
    r"(?i)\bgenerat(es?|ed|ion)\b.{0,40}\b(AI|model|LLM|automat)",
    r"(?i)\b(AI|LLM|models?).{0,40}\b(generat|produc|avoid|omit|skip|rarely|seldom|never)",
    r"(?i)humans?\s+(naturally|tends?|often|rarely|writes?|uses?|prefers?|avoids?)",
    r"(?i)people\s+(tends?|naturally|often|rarely)",
    r"(?i)human\s+writers?",
    r"(?i)(humans|people)\s+(instinctively|spontaneously|unconsciously)",
    r"(?i)\bbecause\b.{5,}",
    r"(?i)\bunlike\b.{10,}",
    r"(?i)\bwhereas\b.{10,}",
    r"(?i)\bin contrast\b.{10,}",
    r"(?i)\bunless prompted\b",
    r"(?i)since\s+(AI|LLM|model|language)",
)
TAUTOLOGY = (
    r"(?i)is a\s+(small |subtle |clear |strong |notable |definitive |tell-?tale )?(sign|tell\b|indicator|marker|clue|hallmark|hint|evidence)",
    r"(?i)(indicates?|suggests?)\s+(human|AI|machine|non-AI|that this)",
    r"(?i)points?\s+to\s+(human|AI|machine)",
    r"(?i)is\s+(consistent|inconsistent)\s+with\s+(human|AI|machine)",
)


def matches_any(c: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike(p)
    return out


def strip_return_token(c: Column) -> Column:
    return F.regexp_replace(c, r"<\|return\|>$", "")


def normalize_attribute_spacing(c: Column) -> Column:
    """Blanks inside the type and score attributes dropped, types in their canonical case."""
    out = F.regexp_replace(c, r'(?i)type="\s*ai\s*"', 'type="AI"')
    out = F.regexp_replace(out, r'(?i)type="\s*human\s*"', 'type="human"')
    return F.regexp_replace(out, r'score="\s*([0-9]*\.?[0-9]+)\s*"', 'score="$1"')


def collapse_double_entities(c: Column, passes: int = 6) -> Column:
    for _ in range(passes):
        c = F.replace(F.replace(c, F.lit("&amp;apos;"), F.lit("&apos;")), F.lit("&amp;quot;"), F.lit("&quot;"))
    return c


def json_object(c: Column, schema: str) -> Column:
    """The object between the first ``{`` and the last ``}`` of a response, parsed; null if it doesn't parse."""
    return F.from_json(F.regexp_extract(c, r"(?s)(\{.*\})", 1), schema)


def probability(c: Column, field: str = "p_ai") -> Column:
    """A field of a JSON response, else the first number between 0 and 1 in its text, within 0..1."""
    n = F.coalesce(F.get_json_object(c, f"$.{field}").try_cast("double"), F.nullif(F.regexp_extract(c, r"(0(?:\.\d+)?|1(?:\.0+)?)", 1), F.lit("")).try_cast("double"))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), n))


def needs_rewrite(c: Column) -> Column:
    """An explanation under 60 characters, one that names no mechanism, or one that names one and still only restates the verdict."""
    why = F.trim(F.coalesce(c, F.lit("")))
    return (F.length(why) < 60) | ~matches_any(why, MECHANISM) | matches_any(why, TAUTOLOGY)


def is_standalone(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    out = F.lit(True)
    for phrase in DEPENDENT:
        out = out & ~F.contains(low, F.lit(phrase))
    return out


def curly_quotes(c: Column) -> Column:
    """Straight quotes as typographic ones: opening at the start or after a blank or bracket, else closing; within a word an apostrophe."""
    out = F.regexp_replace(c, r'(?<=^|[\s({\[])"', "“")
    out = F.replace(out, F.lit('"'), F.lit("”"))
    out = F.regexp_replace(out, r"(?U)(\w)'(\w)", "$1’$2")
    out = F.regexp_replace(out, r"(?<=^|[\s({\[])'", "‘")
    return F.replace(out, F.lit("'"), F.lit("’"))


def escaped_comment(c: Column) -> Column:
    """``& < >`` as entities, then typographic quotes."""
    out = c
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return curly_quotes(out)


def unquoted_words(c: Column) -> Column:
    """Words between white space outside quoted sections."""
    return F.size(white_words(F.regexp_replace(c, r'“[^”]*”|"[^"]*"', "")))


def response_text(c: Column) -> Column:
    """The part of a completion that is meant for the user: its block of the channel 'final', else its last block of any channel, else the
    completion without its thinking and without backticks around it (unless nothing is left)."""
    block = r"(?s)<\|channel\|>\s*([^<\s]+)\s*<\|message\|>(.*?)(?=<\|channel\|>|<\|end\|>|<\|return\|>|$)"
    names = F.regexp_extract_all(c, F.lit(block), F.lit(1))
    bodies = F.regexp_extract_all(c, F.lit(block), F.lit(2))
    final = F.array_position(F.transform(names, lambda n: F.lower(F.trim(n)) == "final"), True)
    plain = F.regexp_replace(strip(F.regexp_replace(c, r"(?s)<\|channel\|>\s*analysis\s*<\|message\|>.*?<\|end\|>", "")), r"^`+|`+$", "")
    return F.when(F.size(bodies) > 0, strip(F.coalesce(F.when(final > 0, F.try_element_at(bodies, final.cast("int"))), F.element_at(bodies, -1)))).when(plain != "", plain).otherwise(strip(c))


def replace_first(c: Column, old: Column, new: Column) -> Column:
    """The first occurrence only."""
    at = F.instr(c, old)
    return F.when(at > 0, F.concat(F.substr(c, F.lit(1), at - 1), new, F.substr(c, at + F.length(old), F.length(c)))).otherwise(c)


def truncate_words(words: Column, longest: int, lookback: int = 25) -> Column:
    """The first ``longest`` words, cut back to the last end of a sentence among the last ``lookback`` words if there is one (never to nothing)."""
    head = F.slice(words, 1, longest)
    seen = F.least(F.lit(lookback), F.size(head) - 1)
    tail = F.reverse(F.slice(head, F.size(head) - seen + 1, F.greatest(seen, F.lit(0))))
    back = F.array_position(F.transform(tail, lambda w: w.rlike(r"[.!?]$")), True)
    return F.when(F.size(words) <= longest, words).when(back > 0, F.slice(head, F.lit(1), (F.size(head) - back + 1).cast("int"))).otherwise(head)


def first_match(c: Column, patterns: tuple[str, ...]) -> Column:
    """The number the first pattern that matches captures; over 1 it is a percentage; rounded to four places."""
    n = F.coalesce(*[F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in patterns]).try_cast("double")
    return F.round(F.when(n > 1, n / 100).otherwise(n), 4)


def from_inverted_index(index: Column) -> Column:
    """Text from a map word -> positions."""
    places = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda i: F.struct(i.alias("i"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(places), lambda p: p["w"]), " ")


def rubric_scores(c: Column, n: int, field: str = "ann") -> Column:
    """The numbers of the last object of a response that starts with ``field``, within 0..1; null unless there are ``n``."""
    last = F.concat(F.lit(f'{{"{field}":'), F.element_at(F.split(c, rf'\{{"{field}":'), -1))
    numbers = F.from_json(F.regexp_extract(last, rf'\{{"{field}":\s*(\[[^\]]*\])', 1), "array<double>")
    return F.when(F.size(numbers) == n, F.transform(numbers, lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))))


def scorer_text(c: Column, openings: tuple[str, ...]) -> Column:
    """A response as a scorer gets it: what follows the thinking, without a first paragraph that opens like an assistant (if there are more), in lower case, white space collapsed."""
    from quern.functions.text import let, squeeze

    answer = F.when(F.contains(c, F.lit("</think>")), strip(F.substr(c, F.instr(c, "</think>") + 8, F.length(c)))).otherwise(c)

    def join(p: Column) -> Column:
        head = F.regexp_replace(F.try_element_at(p, F.lit(1)), "^[^a-zA-Z0-9]*", "")
        stock = F.lit(False)
        for o in openings:
            stock = stock | F.startswith(head, F.lit(o))
        return F.array_join(F.when((F.size(p) > 1) & stock, F.slice(p, F.lit(2), F.size(p))).otherwise(p), "\n")

    return squeeze(F.lower(let(F.filter(F.split(answer, "\n"), lambda x: strip(x) != ""), join)))


def unwrapped(wire: Column) -> Column:
    """What stands between ``<text>`` and the last verdict of a wire; null without either."""
    return F.nullif(F.regexp_extract(wire, r'(?s)^<text>(.*)<verdict type="', 1), F.lit(""))


def annotation_tag(kind: Column, why: Column, score: Column) -> Column:
    from quern.functions.text import escape_document

    attr = lambda name, x: F.concat(F.lit(f' {name}="'), escape_document(x), F.lit('"'))
    return F.concat(F.lit("<annotation"), attr("type", kind), attr("why", F.trim(why)), attr("score", score), F.lit(" />"))


def bare_wire(document: Column, kind: Column, why: Column, score: Column) -> Column:
    """A wire without tells."""
    from quern.functions.text import escape_document

    tag = F.replace(annotation_tag(kind, why, score), F.lit("<annotation"), F.lit("<verdict"))
    return F.concat(F.lit("<text>"), escape_document(document), tag, F.lit("</text>"))


def tag_attribute(tag: Column, name: str) -> Column:
    """An attribute in double quotes, else in single quotes, escaped quotes inside resolved; null without it."""
    double = F.regexp_extract(tag, rf'{name}\s*=\s*"((?:\\.|[^"])*)"', 1)
    single = F.regexp_extract(tag, rf"{name}\s*=\s*'((?:\\.|[^'])*)'", 1)
    has = lambda q: tag.rlike(rf"{name}\s*=\s*{q}")
    return F.when(has('"'), F.replace(double, F.lit('\\"'), F.lit('"'))).when(has("'"), F.replace(single, F.lit("\\'"), F.lit("'")))


def patch_last_verdict(wire: Column, score: Column) -> Column:
    """The wire with the score of its last verdict replaced, in two places after the point."""
    pattern = r'(?s)^(.*<verdict type="(?:AI|human)" why="(?:[^"\\]|\\.)*" score=")([0-9]*\.?[0-9]+)(".*)$'
    return F.when(wire.rlike(pattern), F.concat(F.regexp_extract(wire, pattern, 1), F.format_string("%.2f", score), F.regexp_extract(wire, pattern, 3))).otherwise(wire)


def first_why_span(wire: Column) -> Column:
    """``struct(start, end)`` of the characters of the first explanation."""
    start = F.instr(wire, 'why="') + 4
    value = F.regexp_extract(wire, r'why="((?:[^"\\]|\\.)*)"', 1)
    return F.when(F.instr(wire, 'why="') > 0, F.struct(start.cast("int").alias("start"), (start + F.length(value)).cast("int").alias("end")))
