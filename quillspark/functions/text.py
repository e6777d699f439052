"""Column functions over text, tags, headers and links.  All are built-in expressions; none runs Python on rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Header names that mark bulk mail, record kinds, sources of provenance, model families with a calibrated floor.
BULK_SIGNALS = ("list-id", "list-unsubscribe", "precedence", "auto-submitted")
KINDS = ("note", "session-transcript", "mail-message", "mail-thread")
PROVENANCE_SOURCES = ("explicit", "resolved", "inferred", "unknown")
MODEL_FLOORS = {"qwen3-embedding": 0.4}


def normalize_tag(tag: Column) -> Column:
    """Lower kebab-case: runs of anything but letters and digits and case borders become one '-'."""
    x = F.regexp_replace(tag, r"([a-z0-9])([A-Z])", "$1-$2")
    x = F.regexp_replace(x, r"([A-Z])([A-Z][a-z])", "$1-$2")
    x = F.regexp_replace(x, r"[^A-Za-z0-9]+", "-")
    return F.lower(F.regexp_replace(x, r"^-+|-+$", ""))


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def heading_tags(line: Column) -> Column:
    """The tags of a heading's suffix :a:b:, which follows a space or an empty title; an empty array without one."""
    found = F.regexp_extract(line, r"^\*+ (?:.*[ \t])?:([^ \t:]+(?::[^ \t:]+)*):[ \t]*$", 1)
    return F.when(found == "", F.array().cast("array<string>")).otherwise(F.split(found, ":"))


def extract_tags(text: Column) -> Column:
    """Tags of headings and of #+filetags: lines, normalized, without repeats, sorted."""
    of_file = lambda x: F.filter(F.split(F.regexp_extract(x, r"(?i)^#\+filetags:(.*)$", 1), r"[:\s]+"), lambda t: t != "")
    every = F.flatten(F.transform(lines(text), lambda x: F.concat(heading_tags(x), of_file(x))))
    return F.array_sort(F.filter(F.array_distinct(F.transform(every, normalize_tag)), lambda t: t != ""))


def title_of(kind: Column, text: Column) -> Column:
    """Notes and transcripts: the first #+title:, even a blank one, else the first top heading without its tags.  Mail: the subject."""
    org = F.coalesce(
        F.trim(F.try_element_at(F.regexp_extract_all(text, F.lit(r"(?m)^#\+title:(.*)$"), F.lit(1)), F.lit(1))),
        F.trim(F.regexp_replace(F.try_element_at(F.regexp_extract_all(text, F.lit(r"(?m)^\* (.*)$"), F.lit(1)), F.lit(1)), r"(^|[ \t]):[^ \t]+:[ \t]*$", "")),
        F.lit(""),
    )
    return F.when(kind.isin("mail-message", "mail-thread"), header_value(text, "subject")).otherwise(org)


def header_block(raw: Column) -> Column:
    """What stands before the first blank line."""
    return F.split(raw, "\n\n", 2)[0]


def header_value(raw: Column, name: str) -> Column:
    """The first header of that name, unfolded, white space collapsed; '' if there is none."""
    head = F.regexp_replace(header_block(raw), r"\n[ \t]+", " ")
    return F.trim(F.regexp_replace(F.regexp_extract(head, rf"(?im)^{name}[ \t]*:(.*)$", 1), r"\s+", " "))


def header_names(raw: Column) -> Column:
    """Lower-case names of all headers; continuation lines have none."""
    own = F.filter(lines(header_block(raw)), lambda x: ~x.rlike(r"^[ \t]") & x.contains(":"))
    return F.transform(own, lambda x: F.lower(F.trim(F.split(x, ":", 2)[0])))


def classify_bulk(raw: Column, signals: tuple = BULK_SIGNALS) -> Column:
    """The first header name among the signals, or null: not bulk."""
    return F.try_element_at(F.array_intersect(header_names(raw), F.array(*[F.lit(s) for s in signals])), F.lit(1))


def kind_for_tags(tags: Column) -> Column:
    return F.when(F.array_contains(tags, "conversation"), "session-transcript").otherwise("note")


def name_slug(text: Column) -> Column:
    """The first #+name: that is not blank, else null."""
    names = F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^#\+name:(.*)$"), F.lit(1)), lambda x: F.trim(x))
    return F.try_element_at(F.filter(names, lambda x: x != ""), F.lit(1))


def link_kind(target: Column) -> Column:
    return F.when(target.startswith("id:"), "record").when(target.contains("://") | target.startswith("mailto:"), "url").otherwise("name")


def body_without_links(text: Column) -> Column:
    """Links shown as their description, else their target."""
    return F.regexp_replace(F.regexp_replace(text, r"\[\[[^\]\n]*\]\[([^\]\n]*)\]\]", "$1"), r"\[\[([^\]\n]*)\]\]", "$1")


def tokens(text: Column) -> Column:
    """The text index's tokens: runs of letters and digits, lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def query_terms(query: Column) -> Column:
    """White-space tokens without control characters, empty ones left out."""
    return F.filter(F.split(F.regexp_replace(query, r"[\x00-\x08\x0E-\x1F\x7F]", ""), r"\s+"), lambda t: t != "")


def bracket_id(x: Column) -> Column:
    return F.when((x == "") | (x.startswith("<") & x.endswith(">")), x).otherwise(F.concat(F.lit("<"), x, F.lit(">")))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def normalize_stream(kind: Column, text: Column) -> Column:
    """A version line and the text: mail with LF line ends, notes without runs of blank lines and with trimmed heading tags."""
    mail = F.regexp_replace(text, "\r\n", "\n")
    note = F.regexp_replace(F.regexp_replace(text, r"(?m)^(\*+ .*\S)[ \t]+(:[^ \t\n]+:)[ \t]*$", "$1 $2"), r"\n{3,}", "\n\n")
    return F.concat(F.lit("stream/3\n"), F.when(kind.startswith("mail"), mail).otherwise(note))


def strip_thinking(text: Column) -> Column:
    """Without <think> blocks; one that never ends takes the rest."""
    return F.trim(F.regexp_replace(text, r"(?is)<think>.*?(</think>|$)", ""))


def clean_completion(text: Column) -> Column:
    """A model's answer without thinking, label, outer and inner quotes, on one line."""
    x = F.regexp_replace(strip_thinking(text), r"(?i)^\s*(rewritten|rewrite|query|output|answer)\s*:\s*", "")
    return F.trim(F.regexp_replace(F.regexp_replace(x, '"', ""), r"\s+", " "))


def rewrite_template(question: Column, operator: str = "the operator") -> Column:
    """Statement form of a question: no '?', no interrogative opening of any and/or clause, first person named."""
    # Interrogative openings.
    opening = r"(?i)(^|\s(?:and|or)\s+)(?:what|which|who|when|where|why|how)(?:\s+(?:is|are|was|were|do|does|did|can|could|should|would|has|have))?\s+"
    x = F.trim(F.regexp_replace(F.regexp_replace(question, r"\?+\s*$", ""), r"\s+", " "))
    x = F.regexp_replace(x, opening, "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"(?i)\b(my|our)\b", operator + "'s"), r"(?i)\b(I|me|we|us)\b", operator))


def escape_markup(text: Column) -> Column:
    """Lines that would open a heading or keyword get a space in front."""
    return F.regexp_replace(text, r"(?m)^(?=\*|#\+)", " ")


def fallback_title(hint: Column, first_line: Column, conversation: Column) -> Column:
    blank = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return F.left(F.coalesce(blank(hint), blank(first_line), conversation), F.lit(80))


def page_name(corpus: Column, record: Column) -> Column:
    return F.concat_ws("/", corpus, record)


def wikilink(page: Column, alias: Column) -> Column:
    return F.concat(F.lit("[["), page, F.lit("|"), F.translate(alias, "|[]", ""), F.lit("]]"))


def link_markup(kind: Column, target: Column, shown: Column, page: Column) -> Column:
    """A resolved record or name as a wikilink, a url as [shown](target), anything else as plain text."""
    return F.when(page.isNotNull(), wikilink(page, shown)).when(kind == "url", F.concat(F.lit("["), shown, F.lit("]("), target, F.lit(")"))).otherwise(shown)


def spliced(text: Column, marks: Column) -> Column:
    """text with marks[].mark in place of its bytes from marks[].at to marks[].end; marks are in order, and one that overlaps an earlier one or leaves the text is passed over."""
    raw = F.encode(text, "UTF-8")
    size = F.octet_length(text)
    # the end of what has been replaced so far travels with the marks that hold
    held = F.aggregate(
        marks, F.array().cast("array<struct<from:int,at:int,end:int,mark:string>>"),
        lambda s, x: F.when((x["at"] >= F.coalesce(F.try_element_at(s, F.lit(-1))["end"], F.lit(0))) & (x["end"] <= size) & (x["end"] >= x["at"]),
            F.concat(s, F.array(F.struct(F.coalesce(F.try_element_at(s, F.lit(-1))["end"], F.lit(0)).alias("from"), x["at"].alias("at"), x["end"].alias("end"), x["mark"].alias("mark"))))).otherwise(s),
    )
    cut = lambda a, b: F.substring(raw, a + 1, b - a).cast("string")
    parts = F.transform(held, lambda x: F.concat(cut(x["from"], x["at"]), x["mark"]))
    return F.concat(F.array_join(parts, ""), cut(F.coalesce(F.try_element_at(held, F.lit(-1))["end"], F.lit(0)), size))


def shown(text: Column, chars: int = 2000) -> Column:
    return F.left(text, F.lit(chars))


def trimmed(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def strip_drawer(text: Column) -> Column:
    """Without a leading property drawer, if it ends."""
    return F.regexp_replace(text, r"(?s)\A:PROPERTIES:\n.*?:END:\n", "")


def add_drawer(text: Column, fields: dict[str, Column]) -> Column:
    """A property drawer in front of the text; null fields are left out."""
    rows = [F.concat(F.lit(f":{k}: "), v) for k, v in fields.items()]
    return F.concat_ws("\n", F.lit(":PROPERTIES:"), *rows, F.lit(":END:"), text)


def provenance_json(fields: dict[str, Column]) -> Column:
    """The fields as JSON, or null when none is given."""
    return F.when(F.coalesce(*fields.values()).isNotNull(), F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()])))


def provenance_text(fields: dict[str, Column]) -> Column:
    """The fields that are given, a line each under a heading; empty when none is.  A list is its members with commas, and not given when it has none."""
    lines = F.filter(F.array(*[F.when((v.isNotNull()) & (v.cast("string") != ""), F.concat(F.lit(f"{k}: "), v.cast("string"))) for k, v in fields.items()]), lambda x: x.isNotNull())
    return F.when(F.size(lines) > 0, F.concat(F.lit("\nprovenance:\n  "), F.array_join(lines, "\n  "), F.lit("\n"))).otherwise("")


def valid_provenance(value: Column) -> Column:
    """A single line that is not blank."""
    return value.isNull() | ((F.trim(value) != "") & ~value.contains("\n"))


def model_floor(model: Column, floors: dict[str, float] = MODEL_FLOORS) -> Column:
    found = F.lit(-1.0)
    for family, floor in floors.items():
        found = F.when(F.lower(model).contains(family), F.lit(floor)).otherwise(found)
    return found


def model_prefix(model: Column, text: Column, side: str) -> Column:
    """What a model family wants in front of a query or document."""
    # Prefixes by family.
    name = F.lower(model)
    if side == "query":
        prefix = F.when(name.contains("nomic"), "search_query: ").when(name.contains("e5"), "query: ").otherwise("")
    else:
        prefix = F.when(name.contains("nomic"), "search_document: ").when(name.contains("e5"), "passage: ").otherwise("")
    return F.concat(prefix, text)


def epoch_to_iso(seconds: Column) -> Column:
    """UTC, to the second, with Z."""
    return F.date_format(F.timestamp_micros((seconds * 1_000_000).cast("long")), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_time(text: Column) -> Column:
    """An RFC 3339 time, else null."""
    return F.try_to_timestamp(text)


def without_reminders(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)<system-reminder>.*?</system-reminder>", "")


def mentions(text: Column, name: str) -> Column:
    """Is the store named as a word, outside reminder blocks?"""
    return without_reminders(text).rlike(rf"(?i)(?<![\w-]){name}(?![\w-])")


def usage_calls(text: Column, command: str, verbs: tuple) -> Column:
    """Verbs of `command verb` calls in shell text."""
    return F.regexp_extract_all(text, F.lit(rf"(?<![\w/-]){command}\s+({'|'.join(verbs)})\b"), F.lit(1))


def classify_error(text: Column) -> Column:
    t = F.lower(text)
    return F.when(t.rlike("database|locked|sqlite"), "database").when(t.rlike("connection|timeout|refused|transport"), "transport").when(text.isNotNull(), "tool")


def synthesize_submission(text: Column, new_id: Column) -> Column:
    """The text with its first :ID: property set to another id."""
    parts = F.split(text, r"(?m)^:ID:[^\n]*$", 2)
    return F.when(F.size(parts) > 1, F.concat(parts[0], F.lit(":ID: "), new_id, parts[1])).otherwise(text)


def rewrite_tags(text: Column, change) -> Column:
    """change(token) -> token or '' for every tag on #+filetags: lines; an emptied line goes."""
    def line(x: Column) -> Column:
        kept = F.filter(F.transform(F.filter(F.split(F.regexp_extract(x, r"(?i)^#\+filetags:(.*)$", 1), r"[:\s]+"), lambda t: t != ""), change), lambda t: t != "")
        new = F.when(F.size(kept) > 0, F.concat(F.lit("#+filetags: :"), F.array_join(F.array_distinct(kept), ":"), F.lit(":")))
        return F.when(F.lower(x).startswith("#+filetags:"), new).otherwise(x)

    return F.array_join(F.filter(F.transform(lines(text), line), lambda x: x.isNotNull()), "\n")


def strip_tags(text: Column, tags: list[str]) -> Column:
    """Without these tags, in whatever spelling, on #+filetags: lines; an emptied line goes."""
    gone = F.array(*[normalize_tag(F.lit(t)) for t in tags])
    return rewrite_tags(text, lambda t: F.when(F.array_contains(gone, normalize_tag(t)), "").otherwise(t))


def place_tags(text: Column, tags: Column) -> Column:
    """Tags added to the #+filetags: line, or on such a line put in front."""
    added = F.concat(F.array_join(tags, ":"), F.lit(":"))
    has = text.rlike(r"(?im)^#\+filetags:.*:[ \t]*$")
    return F.when(F.size(tags) == 0, text).when(has, F.regexp_replace(text, F.lit(r"(?im)^(#\+filetags:.*:)[ \t]*$"), F.concat(F.lit("$1"), added))).otherwise(
        F.concat(F.lit("#+filetags: :"), added, F.lit("\n"), text)
    )
