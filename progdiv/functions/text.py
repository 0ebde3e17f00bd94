"""Text transforms as columns."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACEHOLDER = "## DESCRIPTION"


def strip(c: Column) -> Column:
    """Without white space at both ends (all of it, not only blanks)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def squeeze_newlines(c: Column) -> Column:
    return F.regexp_replace(c, r"\n+", "\n")


def squeeze_blank_lines(c: Column, suffix: str = "") -> Column:
    once = F.replace(F.replace(c, F.lit("\n\n\n"), F.lit("\n")), F.lit("\n\n"), F.lit("\n"))
    return F.concat(once, F.lit(suffix)) if suffix else once


def clean_output(c: Column, most: int = 5000) -> Column:
    """Stripped, then cut at most characters."""
    return F.substring(strip(c), 1, most)


def format_prompt(template: Column, description: Column) -> Column:
    """Every placeholder replaced; fails if the description brings in another."""
    out = F.replace(template, F.lit(PLACEHOLDER), description)
    return F.when(F.assert_true(~out.contains(PLACEHOLDER), "placeholder left in prompt").isNull(), out)


def wrap_open_ended(wrapper: Column, program: Column, extract: Column) -> Column:
    """Both marks replaced; fails if one is left."""
    out = F.replace(F.replace(wrapper, F.lit("## REPLACE F"), program), F.lit("## REPLACE EXTRACT_ARGUMENTS"), extract)
    return F.when(F.assert_true(~out.contains("## REPLACE"), "mark left in wrapper").isNull(), out)


def verbalised_prompt(description: Column) -> Column:
    return F.concat(F.lit("Generate a program completion in python for the given function description: "), description)


def example_prompt(instruction: Column, example: Column, answer: Column, description: Column) -> Column:
    """A prompt with one worked example before the description in question."""
    return F.concat_ws("\n\n", instruction, F.concat(F.lit("Description:\n"), example), F.concat(F.lit("Answer:\n"), answer), F.concat(F.lit("Description:\n"), description), F.lit("Answer:"))


def wrap_directed(prefix: Column, program: Column) -> Column:
    return F.concat(prefix, F.lit("\n\n"), program)


def clean_nbsp(c: Column) -> Column:
    return strip(F.replace(c, F.lit(" "), F.lit("")))


def code_point(n: Column) -> Column:
    """The character of a number; the replacement character where there is none."""
    known = n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
    return F.decode(F.unhex(F.lpad(F.hex(F.when(known, n).otherwise(0xFFFD)), 8, "0")), "UTF-32")


def decode_references(c: Column) -> Column:
    """Character references (names of HTML 4 and apos, decimal and hexadecimal numbers) as what they stand for, each once: what
    a reference gives is never read as part of another. Unknown names stay; null stays null."""
    pattern = "&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);"
    names = F.create_map(*(F.lit(x) for name, n in [*name2codepoint.items(), ("apos", 39)] for x in (name, chr(n))))

    def meant(ref: Column) -> Column:
        number = F.when(F.lower(ref).startswith("#x"), F.conv(F.substring(ref, 3, 8), 16, 10)).when(ref.startswith("#"), F.substring(ref, 2, 9)).try_cast("long")
        return F.when(ref.startswith("#"), code_point(F.coalesce(number, F.lit(0)))).otherwise(F.coalesce(F.try_element_at(names, ref), F.concat(F.lit("&"), ref, F.lit(";"))))

    refs = F.concat(F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), meant), F.array(F.lit("")))
    return F.when(c.contains("&"), F.array_join(F.zip_with(F.split(c, pattern, -1), refs, lambda text, ref: F.concat(text, ref)), "")).otherwise(c)


def html_to_text(c: Column) -> Column:
    """Text between tags, without separators; comments go, the five basic entities and nbsp are decoded."""
    out = F.regexp_replace(F.regexp_replace(c, r"(?s)<!--.*?-->", ""), r"<[^>]*>", "")
    for name, value in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(value))
    return out


def decoded_html(c: Column) -> Column:
    """As html_to_text, but all character references that decode_references knows are decoded."""
    return decode_references(F.regexp_replace(F.regexp_replace(c, r"(?s)<!--.*?-->", ""), r"<[^>]*>", ""))


def confidence(c: Column) -> Column:
    """The first stated percentage as a share; null if none."""
    return F.try_divide(F.regexp_extract(c, r"Confidence:\s*(\d+)%", 1).try_cast("int"), F.lit(100))


def strip_comments(c: Column) -> Column:
    """Without everything from a # to the end of its line, also inside strings."""
    return F.regexp_replace(c, "#[^\n]*", "")


def newline_tokens(tokens: Column) -> Column:
    return F.array_join(F.transform(tokens, lambda t: F.replace(t, F.lit("\n"), F.lit("NEWLINE"))), " ")


def hoist_docstrings(c: Column) -> Column:
    """All triple-quoted strings, double quotes first, as one leading docstring; empty if none."""
    double, single = r'(?s)"""(.*?)"""', r"(?s)'''(.*?)'''"
    found = F.concat(F.regexp_extract_all(c, F.lit(double), F.lit(1)), F.regexp_extract_all(F.regexp_replace(c, double, ""), F.lit(single), F.lit(1)))
    return F.when(F.size(found) > 0, F.concat(F.lit('"""\n'), F.array_join(found, "\n"), F.lit('\n"""'))).otherwise("")


def without_docstrings(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r'(?s)""".*?"""', ""), r"(?s)'''.*?'''", "")


def serialize_arguments(*fields: Column) -> Column:
    """Fields line by line; arrays joined by blanks."""
    return F.concat_ws("\n", *fields)


def clean_name(c: Column) -> Column:
    return F.replace(c, F.lit("/"), F.lit("-"))


def short_template(c: Column) -> Column:
    return F.regexp_replace(c, r"^(open_ended_|directed_)+", "")


def left_justify(c: Column, width: int) -> Column:
    return F.rpad(c, F.greatest(F.length(c), F.lit(width)), F.lit(" "))


def generation_index(path: Column) -> Column:
    return F.regexp_extract(path, r"generation_(\d+)", 1).try_cast("int")


def token_budget(model: Column, prompt_tokens: Column, most: Column) -> Column:
    return F.when(model.contains("tatsu"), F.least(2000 - prompt_tokens, most)).when(F.lower(model).contains("codellama"), F.least(4000 - prompt_tokens, most)).otherwise(most)


def route_backend(model: Column) -> Column:
    """Which kind of generator serves a model: completion service, message service or local weights."""
    return F.when(model.rlike("gpt|babbage|davinci"), "completion").when(model.isin("SONNET", "HAIKU", "OPUS"), "message").otherwise("local")


def parse_record_name(c: Column) -> Column:
    """(number, label) of output_record_<number>_<label>; (99, coh_99) otherwise."""
    n = F.regexp_extract(c, r"output_record_(\d+)_(.*)", 1).try_cast("int")
    return F.struct(F.coalesce(n, F.lit(99)).alias("number"), F.when(n.isNotNull(), F.regexp_extract(c, r"output_record_(\d+)_(.*)", 2)).otherwise("coh_99").alias("label"))


def preprocess_for_embedding(tokens: Column, most: int = 512, spare: int = 8) -> Column:
    """The first most - spare tokens as text."""
    return squeeze_newlines(strip(F.array_join(F.slice(tokens, 1, most - spare), " ")))


def rename_map_string(names: Column) -> Column:
    """A map as sorted `key value` pairs joined by ` | `."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(names)), lambda e: F.concat(e["key"], F.lit(" "), e["value"])), " | ")


def merged_names(first: Column, second: Column) -> Column:
    """Both maps as one; a key that both have is an error."""
    return F.map_concat(first, second)


def inverse_names(names: Column) -> Column:
    """Keys by values; a value that two keys share is an error."""
    return F.map_from_arrays(F.map_values(names), F.map_keys(names))


def min_max_scaled(c: Column, low: Column, high: Column) -> Column:
    return F.try_divide((c - low) * 100, high - low)


def tokens_13a(c: Column) -> Column:
    """The standard tokens of machine-translation scores: entities decoded, punctuation set apart unless in numbers."""
    out = F.replace(F.replace(F.replace(c, F.lit("<skipped>"), F.lit("")), F.lit("-\n"), F.lit("")), F.lit("\n"), F.lit(" "))
    for name, value in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        out = F.replace(out, F.lit(name), F.lit(value))
    out = F.concat(F.lit(" "), out, F.lit(" "))
    for pattern, new in ((r"([\{-~\[-` -&(-+:-@/])", " $1 "), (r"([^0-9])([.,])", "$1 $2 "), (r"([.,])([^0-9])", " $1 $2"), (r"([0-9])(-)", "$1 $2 ")):
        out = F.regexp_replace(out, pattern, new)
    return F.filter(F.split(out, " +"), lambda t: t != "")
