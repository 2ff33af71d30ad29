"""Column expressions: stripping, pseudonyms, replacement, names of files, and other scalar rules.

Every function takes and returns columns and stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's str.strip removes at either end.
STRIPPED = r"[\p{Z}\s\x1c-\x1f\x85]+"
BANNER_MARK = "CRITICAL RECIPIENT INSTRUCTIONS"
RULE = "=" * 80


def strip(text: Column) -> Column:
    """Without white space at its ends, as Python has it; Spark's trim only takes spaces."""
    return F.regexp_replace(text, f"^{STRIPPED}|{STRIPPED}$", "")


def pseudonym(name: Column, kind: Column, salt: Column) -> Column:
    """TYPE_XXXXXXXX: the type, and eight hex digits of SHA-256 over the salt's text and the name in lower case. The type is not hashed."""
    digest = F.sha2(F.concat(salt, F.lower(strip(name))).cast("binary"), 256)
    return F.concat(F.upper(strip(kind)), F.lit("_"), F.upper(F.substring(digest, 1, 8)))


def replace_in_order(text: Column, pairs: Column) -> Column:
    """Replaces each pair's k by its v, one pair after another on what the last has left. Literal, with case, without word boundaries."""
    return F.aggregate(pairs, text, lambda done, p: F.replace(done, p["k"], p["v"]))


def occurrences(text: Column, key: Column) -> Column:
    """How often the key stands in the text without overlap; 0 for an empty key."""
    removed = F.length(text) - F.length(F.replace(text, key, F.lit("")))
    return F.when(F.length(key) > 0, (removed / F.length(key)).cast("long")).otherwise(F.lit(0).cast("long"))


def without_banner(text: Column, first_line: int = 6, lines: int = 30) -> Column:
    """What follows the recipient's banner, stripped: after the first rule of 80 = in lines 6 to 29 (from 0). Texts without the banner's mark or such a rule stay as they are."""
    split = F.split(text, "\n", -1)
    places = F.filter(F.sequence(F.lit(first_line), F.greatest(F.lit(first_line), F.least(F.lit(lines), F.size(split)) - 1)), lambda i: F.coalesce(F.contains(F.get(split, i), F.lit(RULE)), F.lit(False)))
    at = F.array_min(places)
    rest = F.array_join(F.slice(split, at + 2, F.greatest(F.size(split) - at - 1, F.lit(0))), "\n")
    return F.when(F.contains(text, F.lit(BANNER_MARK)) & at.isNotNull(), strip(rest)).otherwise(text)


def without_banner_block(text: Column, lines: int = 16) -> Column:
    """As without_banner, but whatever stands before the banner: the rule that ends it is the second after the line with its mark."""
    split = F.split(text, "\n", -1)
    mark = F.array_position(F.transform(split, lambda x: F.contains(x, F.lit(BANNER_MARK))), True)
    rules = F.filter(F.sequence(mark + 1, F.greatest(mark + 1, F.least(mark + lines, F.size(split)).cast("long"))), lambda i: F.coalesce(F.contains(F.get(split, (i - 1).cast("int")), F.lit(RULE)), F.lit(False)))
    end = F.get(rules, F.lit(1)).cast("int")
    rest = F.array_join(F.slice(split, end + 1, F.greatest(F.size(split) - end, F.lit(0))), "\n")
    return F.when(F.contains(text, F.lit(BANNER_MARK)) & end.isNotNull(), strip(rest)).otherwise(text)


# --- files -----------------------------------------------------------------


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """In lower case with its dot; empty for names without one and for names that only begin with one."""
    return F.lower(F.regexp_extract(base_name(path), r"[^.].*?(\.[^.]*)$", 1))


def stem(path: Column) -> Column:
    name = base_name(path)
    return F.substring(name, F.lit(1), F.length(name) - F.length(extension(path)))


def verbatim_name(path: Column) -> Column:
    """Of the transcript of a file. The extension stays in the name, so a.pdf and a.txt don't overwrite each other."""
    return F.concat(F.lit("verbatim_"), base_name(path), F.lit(".json"))


def deidentified_name(path: Column) -> Column:
    return F.concat(F.lit("deidentified_"), base_name(path))


def reidentified_name(path: Column) -> Column:
    """A deidentified_ at the name's start gives way."""
    return F.concat(F.lit("reidentified_"), F.regexp_replace(base_name(path), "^deidentified_", ""))


def is_input(path: Column) -> Column:
    return ~base_name(path).startswith(".") & (base_name(path) != "")


def is_editable(path: Column) -> Column:
    return extension(path).isin(".pdf", ".docx")


#: Extension to route. Text files are taken as they are, CSV and JSON too.
ROUTES = {
    "text": (".txt", ".md", ".markdown", ".rst", ".csv", ".tsv", ".json", ".log"),
    "docx": (".docx", ".doc"),
    "document": (".pdf", ".rtf", ".html", ".xml"),
    "image": (".png", ".jpg", ".jpeg", ".webp"),
    "audio": (".mp3", ".wav", ".m4a", ".flac"),
    "video": (".mp4", ".webm", ".mov", ".avi"),
}


#: MIME types of further extensions, by which their files are routed.
MIMES = {
    ".bmp": "image/bmp", ".css": "text/css", ".epub": "application/epub+zip", ".gif": "image/gif", ".js": "text/javascript", ".mpeg": "video/mpeg",
    ".ogg": "audio/ogg", ".ogv": "video/ogg", ".sql": "application/sql", ".tif": "image/tiff", ".yaml": "application/yaml", ".yml": "application/yaml", ".zip": "application/zip",
}


def mime(path: Column) -> Column:
    """Of a file's extension; null for those that no table here has."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in MIMES.items() for x in pair)), extension(path))


def is_text(content: Column) -> Column:
    """Whether bytes are UTF-8, strictly."""
    return F.is_valid_utf8(content.cast("string"))


def resolved_route(planned: Column, content: Column) -> Column:
    """A route, after a look at the bytes: what may be text or a document is text if its bytes are."""
    return F.when(planned != "text_or_document", planned).when(is_text(content), "text").otherwise("document")


def unreadable(resolved: Column, content: Column) -> Column:
    """Why a file can't be read as its route says, or null. A .doc of the old kind, or any other bytes, is no ZIP file."""
    zipped = F.substring(content, 1, 4) == F.unhex(F.lit("504B0304"))
    return F.when((resolved == "text") & ~is_text(content), "its bytes are not UTF-8").when((resolved == "docx") & ~F.coalesce(zipped, F.lit(False)), "it is not a ZIP file").when(resolved == "unsupported", "its kind is not known")


def route(path: Column, mime: Column | None = None) -> Column:
    """text, docx, document, image, audio, video, text_or_document (try as text first) or unsupported.

    Text and DOCX go by extension; then a MIME type decides where one is given
    and not null, else the extension. The host's MIME tables are not read.
    """
    ext = extension(path)
    by_mime = F.lit(None).cast("string")
    if mime is not None:
        by_mime = (
            F.when(mime.startswith("image/"), "image").when(mime.startswith("audio/"), "audio").when(mime.startswith("video/"), "video")
            .when(mime == "application/pdf", "document").when(mime.startswith("text/"), "text").when(mime.isNotNull(), "text_or_document")
        )
    by_ext = F.lit("unsupported")
    for name in ("video", "audio", "image", "document"):
        by_ext = F.when(ext.isin(*ROUTES[name]), name).otherwise(by_ext)
    return F.when(ext.isin(*ROUTES["text"]), "text").when(ext.isin(*ROUTES["docx"]), "docx").otherwise(F.coalesce(by_mime, by_ext))


# --- markup, display -------------------------------------------------------


def plain_markup(text: Column) -> Column:
    """Tags as spaces, white space as single spaces, stripped."""
    return strip(F.regexp_replace(F.regexp_replace(text, "<[^>]+>", " "), r"[\s\p{Z}\x1c-\x1f\x85]+", " "))


def kilobytes(size: Column) -> Column:
    return F.round(size / 1024, 2)


def masked_secret(secret: Column, shown: int = 4) -> Column:
    """The first and last characters around dots; only dots where that would show it all."""
    short = F.length(secret) <= 2 * shown
    return F.when(short, F.lit("····")).otherwise(F.concat(F.substring(secret, 1, shown), F.lit("····"), F.right(secret, F.lit(shown))))


def version_at_least(version: Column, major: int, minor: int) -> Column:
    part = lambda i: F.regexp_extract(F.coalesce(version, F.lit("")), r"^\s*v?(\d+)(?:\.(\d+))?", i)
    number = lambda i: F.when(part(i) == "", 0).otherwise(part(i).cast("int"))
    return (number(1) > major) | ((number(1) == major) & (number(2) >= minor))


def first_given(*values: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.when(v != "", v) for v in values))


def badge(category: Column) -> Column:
    """The first of the known kinds that the category names."""
    low = F.lower(F.coalesce(category, F.lit("")))
    out = F.lit("badge-unknown")
    for kind in ("activity", "assessment", "interview", "intake"):
        out = F.when(F.contains(low, F.lit(kind)), f"badge-{kind}").otherwise(out)
    return out


#: What an event shows for a field that it lacks.
EVENT_DEFAULTS = {"timestamp": "N/A", "speaker": "Unknown", "category": "", "event_details": ""}


def with_default(field: str, value: Column) -> Column:
    return F.coalesce(value, F.lit(EVENT_DEFAULTS[field]))


def parsed_time(text: Column) -> Column:
    """The timestamp a text gives, else null: texts such as 'Intake Day' are no error."""
    return F.try_to_timestamp(text)


# --- page styles -----------------------------------------------------------

#: The base fonts of a family, as (plain, bold, italic, bold italic), and the words of a font's name that mean the family, first match first.
FAMILIES: Sequence[tuple[tuple[str, ...], tuple[str, str, str, str]]] = (
    (("courier", "mono"), ("cour", "cobo", "coit", "cobi")),
    (("times", "serif"), ("tiro", "tibo", "tiit", "tibi")),
    (("symbol",), ("symb",) * 4),
    (("zapf",), ("zadb",) * 4),
    (("",), ("helv", "hebo", "heit", "hebi")),
)


def base_font(name: Column) -> Column:
    """The base font that stands for a document's font. Any name with 'serif' is Times, sans-serif ones too."""
    low = F.lower(name)
    has = lambda words: _any(F.contains(low, F.lit(w)) for w in words)
    bold, italic = has(("bold", "black", "heavy")), has(("italic", "oblique"))
    out = F.lit(None).cast("string")
    for words, (plain, heavy, slanted, both) in reversed(FAMILIES):
        face = F.when(bold & italic, both).when(bold, heavy).when(italic, slanted).otherwise(plain)
        out = F.when(has(words), face).otherwise(out)
    return out


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def rgb(color: Column) -> Column:
    """0xRRGGBB as a struct of three shares of 1."""
    part = lambda shift: F.shiftright(color, shift).bitwiseAND(F.lit(255)) / F.lit(255.0)
    return F.struct(part(16).alias("r"), part(8).alias("g"), part(0).alias("b"))
