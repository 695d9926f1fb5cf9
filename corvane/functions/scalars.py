"""Scalar functions as columns: identifiers, paths, hashes, rounding, escaping, repository addresses."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions import lookups as L

# --- fixed values: what counts as a name, a dotted name, a string or a path in text
IDENT = r"[A-Za-z_][A-Za-z0-9_]*"
IDENT_WEB = r"[A-Za-z_$][A-Za-z0-9_$]*"
CSS_TOKEN = r"-?-?[A-Za-z_][A-Za-z0-9_-]*"
DOTTED = r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*:[A-Za-z_]\w*|[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+"
DOCTEST = r"(?m)^\s*(?:>>>|\.\.\.)\s?(.*)$"
STRING_LITERAL = r"""(["'`])((?:\\.|(?!\1).)*)\1"""
PY_PATH = r"[\w./-]+\.py\b"
TOP_KEY = r"^([A-Za-z_][\w-]*)\s*:"


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def identifiers(text: Column) -> Column:
    return all_matches(text, IDENT)


def css_tokens(text: Column) -> Column:
    """Names written with a hyphen anywhere; leading hyphens are no part of the name."""
    names = F.filter(all_matches(text, CSS_TOKEN), lambda t: F.contains(t, F.lit("-")))
    return F.transform(names, lambda t: F.regexp_replace(t, "^-+", ""))


def squeeze(text: Column) -> Column:
    """Whitespace runs as one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"\s+", " "), "^ | $", "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def line_count(text: Column) -> Column:
    feeds = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (feeds + F.when((text == "") | text.endswith("\n"), 0).otherwise(1)).cast("long")


def fingerprint(data: Column) -> Column:
    """The first 16 hex digits of SHA-256."""
    return F.substring(F.sha2(data, 256), 1, 16)


def base_name(rel: Column) -> Column:
    return F.element_at(F.split(rel, "/"), -1)


def folder(rel: Column) -> Column:
    return F.regexp_extract(rel, "^(.*)/", 1)


def suffix(rel: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(rel), r"[^.]\.([^.]+)$", 1))


def stem(rel: Column) -> Column:
    return F.regexp_replace(base_name(rel), r"\.[^.]*$", "")


def _map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for x in chain.from_iterable(values.items())))


def language(rel: Column) -> Column:
    """By whole name, else by suffix, else null."""
    return F.coalesce(F.try_element_at(_map(L.NAMED_FILES), base_name(rel)), F.try_element_at(_map(L.LANGUAGES), suffix(rel)))


def is_test_path(rel: Column) -> Column:
    name, parts = base_name(rel), F.split(rel, "/")
    up = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.regexp_like(name, F.lit(r"^test|_tests?\.py$|^conftest\.py$")) | F.arrays_overlap(up, F.array(*map(F.lit, ("tests", "test", "testing"))))


def is_generated(rel: Column, text: Column) -> Column:
    """A banner near the start, very long lines, or the suffix of generated files."""
    lines = line_count(text)
    banner = F.regexp_like(F.substring(F.encode(text, "UTF-8"), 1, L.BANNER_BYTES).cast("string"), F.lit(L.GENERATED_BANNER))
    minified = (lines > 0) & (F.octet_length(text) / F.greatest(lines, F.lit(1)) > L.LONG_LINE)
    return banner | minified | F.regexp_like(rel, F.lit(L.GENERATED_SUFFIX))


def ratio(part: Column, whole: Column, scale: float, digits: int) -> Column:
    """round(scale * part / whole, digits); null without a whole."""
    return F.when((whole.isNotNull()) & (whole != 0), F.round(F.lit(scale) * part / whole, digits))


def per_1000(part: Column, whole: Column) -> Column:
    return ratio(part, whole, 1000.0, 2)


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def markdown_escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("|"), F.lit(r"\|")), r"\s*\n\s*", " ")


def thousands(n: Column) -> Column:
    return F.when(n.isNull(), "n/a").otherwise(F.format_number(n, 0))


def iso_utc(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def nearest_second(t: Column) -> Column:
    """Seconds since 1970 as SQL casts them: to the nearest, halves to the even one, where unix_timestamp cuts off."""
    return F.rint(F.unix_micros(t.cast("timestamp")) / F.lit(1e6)).cast("long")


def ago(then: Column, now: Column) -> Column:
    s = F.unix_timestamp(now) - F.unix_timestamp(then)
    unit = lambda n, name: F.concat(F.floor(s / n).cast("string"), F.lit(name))
    return F.when(s < 60, "just now").when(s < 3600, unit(60, " min ago")).when(s < 86400, unit(3600, " h ago")).otherwise(unit(86400, " d ago"))


def clean_name(name: Column) -> Column:
    return F.substring(squeeze(F.regexp_replace(name, r"[^A-Za-z0-9 ._-]", " ")), 1, 60)


def client_address(forwarded: Column, peer: Column, proxies: int = 1) -> Column:
    """The address that the proxies-th hop from the end saw; the peer's without such a header."""
    hops = F.filter(F.transform(F.split(F.coalesce(forwarded, F.lit("")), ","), strip), lambda x: x != "")
    return F.when(F.size(hops) >= proxies, F.element_at(hops, -proxies)).otherwise(peer)


def keyed_hash(salt: Column, value: Column) -> Column:
    """HMAC-SHA256 of value under a salt of up to 64 bytes, first 24 hex digits."""
    key = F.rpad(F.hex(F.encode(salt, "UTF-8")), 128, "0")
    byte = lambda i, mask: F.lpad(F.hex(F.conv(F.substring(key, 2 * i + 1, 2), 16, 10).cast("int").bitwiseXOR(F.lit(mask))), 2, "0")
    pad = lambda mask: F.concat(*(byte(i, mask) for i in range(64)))
    inner = F.sha2(F.unhex(F.concat(pad(0x36), F.hex(F.encode(value, "UTF-8")))), 256)
    return F.substring(F.sha2(F.unhex(F.concat(pad(0x5C), inner)), 256), 1, 24)


def seal(body: Column, key: Column, nonce: Column, owner: Column) -> Column:
    """AES-GCM with the owner's id as associated data; key of 32 bytes, nonce of 12."""
    return F.aes_encrypt(F.encode(body, "UTF-8"), key, F.lit("GCM"), F.lit("DEFAULT"), nonce, F.encode(owner, "UTF-8"))


def unseal(data: Column, key: Column, owner: Column) -> Column:
    return F.decode(F.aes_decrypt(data, key, F.lit("GCM"), F.lit("DEFAULT"), F.encode(owner, "UTF-8")), "UTF-8")


def repository(url: Column) -> Column:
    """owner/name of a public repository address, or null if the address isn't one."""
    m = r"^(?:https?://)?(?:www\.)?github\.com/([A-Za-z0-9][A-Za-z0-9-]{0,38})/([A-Za-z0-9._-]{1,100}?)(?:\.git)?/?(?:tree/[^?#]*)?$"
    owner, name = F.regexp_extract(url, m, 1), F.regexp_extract(url, m, 2)
    return F.when((owner != "") & ~name.isin("", ".", ".."), F.concat(owner, F.lit("/"), name))


def safe_ref(ref: Column) -> Column:
    return F.regexp_like(ref, F.lit(r"^[A-Za-z0-9][A-Za-z0-9._/-]{0,199}$")) & ~F.contains(ref, F.lit("..")) & ~ref.endswith("/") & ~ref.endswith(".lock")


def safe_member(path: Column) -> Column:
    """Whether an archive member stays inside its folder."""
    parts = F.split(path, "/")
    return ~F.regexp_like(path, F.lit(r"^/|^[A-Za-z]:|\\|[\x00]")) & (path != "") & ~F.arrays_overlap(parts, F.array(F.lit(".."), F.lit("")))


def camel(name: Column) -> Column:
    """kebab-case as camelCase."""
    parts = F.split(name, "-")
    rest = F.transform(F.slice(parts, 2, 1000), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1000)))
    return F.array_join(F.concat(F.slice(parts, 1, 1), rest), "")


def distribution(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit("_"), F.lit("-"))


def module_of(dist: Column) -> Column:
    d = distribution(dist)
    return F.coalesce(F.try_element_at(_map(L.MODULE_OF), d), F.replace(d, F.lit("-"), F.lit("_")))


def is_side_effect(module: Column) -> Column:
    parts = F.split(module, r"\.")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))
    return F.arrays_overlap(heads, F.array(*map(F.lit, L.SIDE_EFFECT_MODULES)))


def last_count(text: Column, pattern: str) -> Column:
    """The number in the last match of a pattern, null without one."""
    return F.try_element_at(all_matches(text, pattern, 1), F.lit(-1)).cast("int")


def fewer_tests(before: Column, after: Column) -> Column:
    """Whether a run passed fewer tests, or skipped more, than the one before it; texts of test runners."""
    passed = lambda t: F.coalesce(last_count(t, r"(\d+) passed"), last_count(t, r"Ran (\d+) tests?"))
    skipped = lambda t: F.coalesce(last_count(t, r"(\d+) skipped"), F.lit(0))
    return F.coalesce(passed(after) < passed(before), passed(before).isNotNull() & passed(after).isNull()) | (skipped(after) > skipped(before))


#: Names of settings that hold secrets.
SECRET_SETTING = r"(?i)TOKEN|SECRET|PASSWORD|PASSWD|API_?KEY|ACCESS_?KEY|PRIVATE|CREDENTIAL|^AZURE_|^AWS_|^GITHUB_|^ANTHROPIC_|^OPENAI_"


def is_secret_setting(name: Column) -> Column:
    """Whether a setting must not reach a foreign test run."""
    return name.rlike(SECRET_SETTING)
