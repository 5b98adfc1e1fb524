"""Column functions: readable numbers and moments, paths, redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def human_bytes(n: Column) -> Column:
    """B, KiB, MiB, GiB, TiB with one decimal (none for bytes)."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in ((1, "KiB"), (2, "MiB"), (3, "GiB"), (4, "TiB")):
        tenths = F.floor(n * F.lit(10) / F.lit(float(1024**power))).cast("long")
        out = F.when(n >= 1024**power, F.concat(F.expr("''"), (F.floor(tenths / 10)).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {unit}"))).otherwise(out)
    return out


def human_duration(seconds: Column) -> Column:
    """The two largest units of a whole number of seconds: 1d 2h, 3h 4m, 5m 6s, 7s."""
    s = seconds.cast("long")
    two = lambda a, x, b, y: F.concat(a.cast("string"), F.lit(f"{x} "), b.cast("string"), F.lit(y))
    whole = lambda x, d: F.floor(x / d).cast("long")
    return F.when(s >= 86_400, two(whole(s, 86_400), "d", whole(s % 86_400, 3600), "h")).when(s >= 3600, two(whole(s, 3600), "h", whole(s % 3600, 60), "m")).when(s >= 60, two(whole(s, 60), "m", s % 60, "s")).otherwise(F.concat(s.cast("string"), F.lit("s")))


def moment(micros: Column) -> Column:
    """A moment in UTC with milliseconds (the session's time zone must be UTC)."""
    return F.date_format(F.timestamp_micros(micros), "yyyy-MM-dd HH:mm:ss.SSS")


def width_label(seconds: Column) -> Column:
    """A bucket's width in its largest whole unit."""
    out = F.concat(seconds.cast("string"), F.lit(" seconds"))
    for size, name in ((60, "minutes"), (3600, "hours"), (86_400, "days")):
        out = F.when(seconds % size == 0, F.concat(F.expr("''"), F.floor(seconds / size).cast("string"), F.lit(f" {name}"))).otherwise(out)
    return out


def realm_of(path: Column) -> Column:
    """The part of a path before its first slash."""
    return F.substring_index(path, "/", 1)


def redact(text: Column) -> Column:
    """Values of assignments to names that look secret become ***."""
    return F.regexp_replace(text, r"(?i)((?:password|passwd|secret|token|api_?key)\s*[=:]\s*)\S+", "$1***")


def valid_name(name: Column) -> Column:
    """Lower-case letters, digits, - _ . /, 1 to 64 of them, starting with a letter or digit, without .. in it."""
    return name.rlike(r"^[a-z0-9][a-z0-9._/-]{0,63}$") & ~name.contains("..")


def clip(text: Column, most: int) -> Column:
    """A text of at most so many characters; a longer one ends with three dots. Null is empty."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most - 3), F.lit("..."))).otherwise(t)


def range_header(start: Column, length: Column) -> Column:
    """The header of a request for a byte range."""
    return F.concat(F.lit("bytes="), start.cast("string"), F.lit("-"), (start + length - 1).cast("string"))


def part_size(total: Column, least: int = 5_242_880, most_parts: int = 10_000) -> Column:
    """Bytes a part of an upload needs so that there are no more than most_parts."""
    return F.greatest(F.lit(least), F.floor((total + (most_parts - 1)) / most_parts)).cast("long")


#: Parts of names whose values are secret, as they stand in settings.
SECRETS = (
    "password", "passwd", "hash_salt", "secret", "private_key", "api_key", "apikey", "access_key", "secret_key", "token",
    "credential", "salt", "dsn", "sentry", "stripe", "twilio", "mailgun", "sendgrid", "smtp_pass", "aws_secret",
)
#: What a secret value is replaced by: neither empty nor valid, so that a restored file fails loudly.
MARKER = "REDACTED_SET_THIS_BEFORE_USE"


def _assigned_at(line: Column) -> Column:
    """Where a line assigns: at its first =>, else at its first =, 0 without either."""
    arrow = F.instr(line, "=>")
    return F.when(arrow > 0, arrow).otherwise(F.instr(line, "="))


def _secret_target(at: Column, target: Column) -> Column:
    """Whether what stands before an assignment, in lower case, is a variable or a quoted key whose name holds a secret's part."""
    assigns = target.contains("$") | target.rlike(r"""['"][a-z0-9_.\-]+['"]\s*$""")
    return (at > 0) & assigns & target.rlike("|".join(SECRETS))


def secret_line(line: Column) -> Column:
    """Whether a line of settings assigns to a variable or a quoted key whose name holds a secret's part."""
    at = _assigned_at(line)
    return _secret_target(at, F.lower(F.substring(line, F.lit(1), at - 1)))


def _read_lines(lines: Column) -> Column:
    """Lines as (x, body, at, target), each part computed once: Spark evaluates what a lambda names again wherever it is used."""
    parts = F.transform(lines, lambda x: F.struct(x.alias("x"), F.rtrim(x, F.lit("\r\n")).alias("body")))
    parts = F.transform(parts, lambda p: F.struct(p["x"].alias("x"), p["body"].alias("body"), _assigned_at(p["body"]).alias("at")))
    return F.transform(parts, lambda p: F.struct(p["x"].alias("x"), p["body"].alias("body"), p["at"].alias("at"), F.lower(F.substring(p["body"], F.lit(1), p["at"] - 1)).alias("target")))


def redact_settings(text: Column) -> Column:
    """A settings file with the values of its secret lines replaced; the end of a statement or list item is kept, other lines as they are."""

    def line(p: Column) -> Column:
        x, body, at = p["x"], p["body"], p["at"]
        rest = F.substring(body, at, F.length(x))
        tail = F.when(rest.contains(";"), ";").when(rest.contains(","), ",").otherwise("")
        made = F.concat(F.substring(x, F.lit(1), at - 1), F.when(F.substring(body, at, F.lit(2)) == "=>", "=>").otherwise("="), F.lit(f" '{MARKER}'"), tail, F.substring(x, F.length(body) + 1, F.length(x)))
        return F.when(_secret_target(at, p["target"]), made).otherwise(x)

    return F.array_join(F.transform(_read_lines(F.split(text, r"(?<=\n)|(?<=\r)(?!\n)")), line), "")


def secret_lines(text: Column) -> Column:
    """How many lines of a settings file are secret."""
    return F.size(F.filter(_read_lines(F.split(text, r"\r\n|\n|\r")), lambda p: _secret_target(p["at"], p["target"]))).cast("long")


#: Characters of a site's id that is made from what the site is.
SITE_LENGTH = 12


def site_id(configured: Column, *identity: Column) -> Column:
    """The id given to a site, without characters that a key can't have; without one, the start of a digest over what the site is."""
    given = F.regexp_replace(F.trim(F.coalesce(configured, F.lit(""))), "[^A-Za-z0-9_-]", "")
    whole = F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in identity])
    return F.when(given != "", given).otherwise(F.substring(F.sha2(whole, 256), 1, SITE_LENGTH))


def site_key(site: Column, key: Column) -> Column:
    """A key under its site's prefix."""
    return F.concat(site, F.lit("/"), F.regexp_replace(key, "^/+", ""))


def own_key(site: Column, key: Column) -> Column:
    """A stored key without its site's prefix, null if it is another site's."""
    prefix = F.concat(site, F.lit("/"))
    return F.when(key.startswith(prefix), F.substring(key, F.length(prefix) + 1, F.length(key)))


#: What values of the model are called.
LABELS = {
    "realm": {"entity": "Entity", "config": "Configuration", "state": "State", "key_value": "Key-Value", "table": "Table", "schema": "Schema", "file": "File", "ephemeral": "Ephemeral", "code": "Code"},
    "verb": {"create": "Create", "update": "Update", "delete": "Delete", "rename": "Rename", "truncate": "Truncate", "ddl": "DDL"},
    "status": {"restorable": "Restorable", "degraded": "Degraded", "unrestorable": "Unrestorable"},
    "classification": {"authoritative": "Authoritative", "derivable": "Derivable", "unclassified": "Unclassified"},
    "strategy": {"refuse": "Refuse", "ours": "Keep Ours", "theirs": "Take Theirs"},
    "outcome": {"unchanged": "Unchanged", "ours": "Kept", "theirs": "Taken From the Branch", "merged": "Merged", "conflict": "Conflict"},
}


def label(kind: str, value: Column) -> Column:
    """What a value of a kind is called, null for an unknown one."""
    return F.create_map(*[F.lit(x) for pair in LABELS[kind].items() for x in pair])[value]
