"""Text cleaning, masking and tokenising as native column expressions.

Java's `\\w`, `\\b` and `\\s` differ from the Unicode classes these semantics call for, so
the patterns spell the word class out (`[\\p{L}\\p{N}_]`) and use look-around instead of
`\\b`. Nothing here leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\s\x1c-\x1f]"
# The same characters one by one: trimming by a set reads a text's ends only.
SPACES = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                           0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

# Literal, comment and token patterns.
# The first look-ahead of a pattern settles nearly all places by one character.
STRING_LITERAL = (
    r"(?=[\"'])(?:"
    r'"""[\s\S]*?"""' r"|'''[\s\S]*?'''"
    r'|"[^\n"\\]*+(?:\\[^\n][^\n"\\]*+)*+"'
    r"|'[^\n'\\]*+(?:\\[^\n][^\n'\\]*+)*+')"
)
NUMBER_LITERAL = rf"(?=\p{{Nd}})(?<!{WORD})\p{{Nd}}+(\.\p{{Nd}}+)?([eE][+-]?\p{{Nd}}+)?(?!{WORD})"
C_COMMENT = r"//[^\n]*|/\*[\s\S]*?\*/"
# White space spelled out, and ASCII first: the Unicode flag makes every test of a character slow.
CORPUS_TOKEN = (r"<[A-Z_]+>|[a-zA-Z0-9_\p{L}\p{N}]+"
                r"|[^\s\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\p{L}\p{N}_]")
SCAN_TOKEN = r"(?U)[A-Za-z_][A-Za-z0-9_]*|\p{Nd}+|[^\s\p{L}\p{N}_]"
DISPLAY_TOKEN = r"[A-Za-z_][A-Za-z0-9_]*"


def strip(text: Column) -> Column:
    """Drop Unicode white space at both ends."""
    return F.trim(text, F.lit(SPACES))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACES))


def splitlines(text: Column) -> Column:
    """Lines of a text; a final line break does not open another line."""
    body = F.regexp_replace(text, rf"({LINE_BREAK})\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(
        F.split(body, LINE_BREAK))


def clean_text(text: Column) -> Column:
    """Unify line ends, drop control characters except tab and newline, strip."""
    given = F.coalesce(text, F.lit(""))
    unified = F.when(F.contains(given, F.lit("\r")), F.regexp_replace(given, r"\r\n?", "\n")).otherwise(given)
    return strip(F.regexp_replace(unified, r"[\x00-\x08\x0B-\x1F\x7F]", ""))


def _drop_blank_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda l: F.ltrim(l, F.lit(SPACES)) != "")
    return F.array_join(lines, "\n")


def strip_hash_comments(code: Column) -> Column:
    """Cut every line at `#` (even inside a string) and drop blank lines."""
    return _drop_blank_lines(F.regexp_replace(code, r"#[^\n]*", ""))


def strip_c_comments(code: Column) -> Column:
    return _drop_blank_lines(F.regexp_replace(code, C_COMMENT, ""))


def strip_comments(code: Column, language: Column) -> Column:
    return F.when(F.lower(strip(language)).isin("py", "python"), strip_hash_comments(code)
                  ).otherwise(strip_c_comments(code))


def mask_literals(code: Column) -> Column:
    """Replace string literals by `<STR>` and then numbers by `<NUM>`."""
    return F.regexp_replace(
        F.regexp_replace(code, STRING_LITERAL, "<STR>"), NUMBER_LITERAL, "<NUM>")


def normalise_code(code: Column, language: Column) -> Column:
    return mask_literals(strip_comments(clean_text(code), language))


def _indent_line(line: Column) -> Column:
    lead = F.regexp_extract(line, rf"(?U)\A{SPACE}*", 0)
    tabs = F.length(lead) - F.length(F.replace(lead, F.lit("\t"), F.lit("")))
    spaces = F.length(lead) - F.length(F.replace(lead, F.lit(" "), F.lit("")))
    level = F.floor((tabs * 4 + spaces) / 4).cast("int")
    body = F.substring(line, F.length(lead) + 1, F.length(line))
    return F.when(body == "", "").otherwise(F.concat(F.repeat(F.lit("    "), level), body))


def normalise_indent(code: Column) -> Column:
    """Indentation as whole steps of four spaces; a tab counts as four."""
    return F.array_join(F.transform(splitlines(code), _indent_line), "\n")


def clean_code(code: Column) -> Column:
    """Scanner cleaning: cut at `#`, right-strip, drop blank lines, normalise indents."""
    cut = F.transform(splitlines(code), lambda l: rstrip(F.substring_index(l, "#", 1)))
    kept = F.filter(cut, lambda l: l != "")
    return F.array_join(F.transform(kept, _indent_line), "\n")


def corpus_tokens(code: Column) -> Column:
    """Tokens of the training corpus: markers, words, single symbols."""
    return F.regexp_extract_all(code, F.lit(CORPUS_TOKEN), F.lit(0))


def scan_tokens(code: Column) -> Column:
    """Tokens fed to the scorer: identifiers, digits, single symbols."""
    return F.regexp_extract_all(code, F.lit(SCAN_TOKEN), F.lit(0))


def display_tokens(code: Column) -> Column:
    """Identifiers only, as shown in a report."""
    return F.regexp_extract_all(code, F.lit(DISPLAY_TOKEN), F.lit(0))


def word_pattern(literal: str) -> str:
    """Whole-word pattern for a literal, with Unicode word characters."""
    def is_word(ch: str) -> bool:
        return ch.isalnum() or ch == "_"

    before = rf"(?<!{WORD})" if is_word(literal[0]) else rf"(?<={WORD})"
    after = rf"(?!{WORD})" if is_word(literal[-1]) else rf"(?={WORD})"
    return before + r"\Q" + literal.replace(r"\E", r"\E\\E\Q") + r"\E" + after


def contains_word(lowered: Column, literal: str) -> Column:
    """Whole-word test; the plain substring test in front settles almost every row."""
    word = literal.lower()
    return F.contains(lowered, F.lit(word)) & lowered.rlike(word_pattern(word))


def sha256_stripped(text: Column) -> Column:
    return F.sha2(strip(text), 256)


# Paths -------------------------------------------------------------------------------

def path_kept(path: Column, ignored) -> Column:
    """No directory on the path is ignored or hidden; the file name is not looked at."""
    parts = F.split(path, "/")
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return ~F.exists(dirs, lambda d: F.lower(d).isin(*ignored) | F.startswith(d, F.lit(".")))


def upload_path_kept(path: Column, parts) -> Column:
    """Folder upload rule: `.py` files whose path contains none of the given parts."""
    full = F.concat(F.lit("/"), F.lower(path))
    bad = F.lit(False)
    for part in parts:
        bad = bad | F.contains(full, F.lit(part))
    return F.endswith(full, F.lit(".py")) & ~bad


def has_extension(path: Column, extension: str = ".py") -> Column:
    """The last extension matches; a leading-dot name has none."""
    name = F.regexp_extract(path, r"([^/]*)\z", 1)
    return F.lower(F.regexp_extract(name, r"\A\.*[^.].*(\.[^.]*)\z", 1)) == extension


def clean_upload_path(path: Column) -> Column:
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"\A/+", "")


def display_name(path: Column, n_files: Column) -> Column:
    """First segment for a folder upload, the base name for a single file."""
    clean = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"\A/+|/+\z", "")
    single = F.regexp_extract(clean, r"([^/]*)\z", 1)
    return F.when(F.contains(clean, F.lit("/")) & (n_files > 1),
                  F.split_part(clean, F.lit("/"), F.lit(1))
                  ).otherwise(F.when(single == "", "Upload Batch").otherwise(single))


def client_address(forwarded: Column, remote: Column) -> Column:
    first = F.trim(F.split_part(forwarded, F.lit(","), F.lit(1)))
    return F.when(F.coalesce(forwarded, F.lit("")) != "", first).otherwise(
        F.coalesce(F.nullif(remote, F.lit("")), F.lit("127.0.0.1")))
