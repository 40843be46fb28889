"""Column builders: everything that one event's values decide. All of it stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallylog.schema import EVENTCHANNEL_DECODER, NO_PAYLOAD

# ---- casts that give null instead of an error ------------------------------------------------------------------------


def to_int(text: Column) -> Column:
    """Integers as text; decimals are rounded half away from zero; else null."""
    return F.coalesce(text.try_cast("int"), F.round(text.try_cast("double")).try_cast("int"))


def to_timestamp(text: Column) -> Column:
    """Date or date and time, with or without a zone. A bare time of day is no timestamp."""
    return F.when(text.rlike(r"^\s*[0-9]{4}-"), F.try_to_timestamp(F.regexp_replace(F.trim(text), r"([+-][0-9]{2})([0-9]{2})$", "$1:$2")))


# ---- JSON ------------------------------------------------------------------------------------------------------------


def boxed(text: Column) -> Column:
    """A line as a variant, in brackets: a second value on the line is then a second element. Null if it is no JSON, or repeats a key."""
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))


def _element(box: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(box, path, kind)


def _repeats_keys(text: Column) -> Column:
    """Whether a line that is no variant is one JSON value all the same. The count takes raw control characters and single quotes, which are no JSON."""
    one = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    strings = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
    return F.coalesce(one & ~F.trim(text, F.lit(" \t\r\n")).rlike(r"[\x00-\x1F]") & ~F.regexp_replace(text, strings, "").contains("'"), F.lit(False))


def is_json(text: Column) -> Column:
    """Whether a text is one JSON value."""
    box = boxed(text)
    return F.coalesce(F.when(box.isNull(), _repeats_keys(text)).otherwise(_element(box, "$[1]").isNull() & _element(box, "$[0]").isNotNull()), F.lit(False))


def holds_one_object(box: Column, text: Column) -> Column:
    """Whether a line, whose :func:`boxed` form is ``box``, is one JSON object."""
    parsed = F.schema_of_variant(_element(box, "$[0]")).startswith("OBJECT") & _element(box, "$[1]").isNull()
    return F.coalesce(F.when(box.isNull(), F.trim(text, F.lit(" \t\r\n")).startswith("{") & _repeats_keys(text)).otherwise(parsed), F.lit(False))


def field(box: Column, text: Column, path: str) -> Column:
    """The text at ``path`` of a line. Of a repeated key the first counts."""
    return F.when(box.isNull(), F.get_json_object(text, path)).otherwise(_element(box, "$[0]" + path.removeprefix("$"), "string"))


# ---- classification --------------------------------------------------------------------------------------------------


def _filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def status(threshold: int, decoder="decoder_name", rule_id="rule_id", level="rule_level") -> Column:
    return (
        F.when(_filled(F.col(decoder)).isNull(), "no_decoder")
        .when(_filled(F.col(rule_id)).isNull(), "no_alerting_rule")
        .when(F.col(level).isNull() | (F.col(level) < threshold), "below_threshold")
        .otherwise("at_or_above_threshold")
    )


def log_type(decoder="decoder_name", program="program_name", location="location") -> Column:
    return F.coalesce(*[_filled(F.col(c)) for c in (decoder, program, location)], F.lit("unknown"))


# ---- normalization ---------------------------------------------------------------------------------------------------

# The shapes that are masked.
_D2, _D4 = "[0-9]{2}", "[0-9]{4}"
_CLOCK = f"{_D2}:{_D2}:{_D2}"
_ZONE = rf"(?:Z|[+-]{_D2}:{_D2})"
_PART = r"(?:[.,][0-9]+)"
_MONTH = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
_DAY = "(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)"
#: The shapes of a timestamp that a message may begin with. Of two where one begins the other, the longer comes first.
TIMESTAMPS = (
    rf"{_D4}-{_D2}-{_D2}T{_CLOCK}{_PART}?{_ZONE}",
    rf"{_D4}-{_D2}-{_D2}T{_CLOCK}{_PART}?",
    rf"{_D4}-{_D2}-{_D2} {_CLOCK}{_PART}?{_ZONE}?",
    rf"{_MONTH}[ \t]+[0-9]{{1,2}}[ \t]+{_CLOCK}",
    rf"{_D2}/{_MONTH}/{_D4}:{_CLOCK} [+-]{_D4}",
    rf"{_DAY} {_MONTH} {{1,2}}[0-9]{{1,2}} {_CLOCK} {_D4}",
    rf"{_D2}/{_D2}/{_D4} {_CLOCK}(?:\.[0-9]+)?",
    r"[0-9]{8}T[0-9]{6}(?:\.[0-9]+)?Z",
)
TIMESTAMP = "(?:" + "|".join(TIMESTAMPS) + ")"
_X = "[0-9A-Fa-f]"
UUID = f"{_X}{{8}}-{_X}{{4}}-{_X}{{4}}-{_X}{{4}}-{_X}{{12}}"
HEX = f"(?:0x)?{_X}{{16,}}"
NUM = "[0-9]{5,}"
# ASCII word boundaries: Java's own take other letters for word characters, too.
_EDGES = "(?<![0-9A-Za-z_]){}(?![0-9A-Za-z_])"


def trim_spaces(text: Column) -> Column:
    """Strip U+0020 and the other space separators at both ends, but neither tabs nor line ends."""
    return F.regexp_replace(text, r"^\p{Zs}+|\p{Zs}+$", "")


def normalize(log: Column) -> Column:
    """Mask a leading timestamp, then UUIDs, long hexadecimal and long decimal numbers, and trim."""
    text = F.regexp_replace(F.coalesce(log, F.lit("")), f"^{TIMESTAMP}", "<TIMESTAMP>")
    for shape, mask in ((UUID, "<UUID>"), (_EDGES.format(HEX), "<HEX>"), (_EDGES.format(NUM), "<NUM>")):
        text = F.regexp_replace(text, shape, mask)
    return trim_spaces(text)


#: What separates tokens: all that Python's str.split() takes for white space.
WHITE = "\\x09-\\x0D\\x1C-\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, f"[{WHITE}]+"), lambda t: t != "")


# ---- EventChannel records --------------------------------------------------------------------------------------------


def eventchannel_fields(decoder: Column, log: Column) -> Column:
    """[channel, provider, event id] of an EventChannel record, else null."""
    paths = ("channel", "providerName", "eventID")
    got = F.array(*[F.get_json_object(log, f"$.win.system.{p}") for p in paths])
    # A null decoder must be false here, not null: else every text would be parsed.
    return F.when(F.coalesce(decoder, F.lit("")) == EVENTCHANNEL_DECODER, F.when(is_json(log), got))


def eventchannel_pattern(fields: Column) -> Column:
    shown = [F.coalesce(fields[i], F.lit("-")) for i in range(3)]
    empty = fields[0].isNull() & fields[1].isNull() & fields[2].isNull()
    return F.when(fields.isNull(), F.lit(None)).when(empty, NO_PAYLOAD).otherwise(F.concat(F.lit("channel="), shown[0], F.lit(" provider="), shown[1], F.lit(" eventID="), shown[2]))


# ---- findings --------------------------------------------------------------------------------------------------------


def finding_key(status_: Column, rule_key: Column, log_type_: Column, pattern: Column) -> Column:
    """A key that no delimiter in a value can confuse: the digest of a JSON array of the parts."""
    below = F.to_json(F.array(status_, rule_key))
    return F.md5(F.when(status_ == "below_threshold", below).otherwise(F.to_json(F.array(status_, log_type_, pattern))))


def one_line(log: Column) -> Column:
    return trim_spaces(F.regexp_replace(log, r"[\r\n]+", " "))


def shown_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ssx")


def percentage(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.lit(100.0) * part / F.nullif(whole, F.lit(0).cast("long")))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, null when there is nothing to divide by."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def verdict(replay_status: Column, level: Column, threshold: int) -> Column:
    """The effective state that a replay's answer stands for."""
    return (
        F.when(replay_status == "NoDecoder", "no_decoder")
        .when(replay_status == "NoRule", "uncovered")
        .when((replay_status != "RuleMatch") | replay_status.isNull() | level.isNull(), "unverified")
        .when(level == 0, "suppressed")
        .when(level < threshold, "below_threshold")
        .otherwise("at_or_above_threshold")
    )


def outcome(state: Column) -> Column:
    from tallylog.schema import OUTCOME_OF

    out = F.lit(None).cast("string")
    for s, o in OUTCOME_OF.items():
        out = F.when(state == s, o).otherwise(out)
    return out
