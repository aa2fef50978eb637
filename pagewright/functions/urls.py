"""URL expressions: split, resolve, normalise, classify.

Everything is Spark SQL text.  `split_url` runs one regex per URL and the other
functions work on its parts.  Splitting follows RFC 3986 appendix B, including
URLs with characters that Spark's own ``parse_url`` rejects.
"""

from __future__ import annotations

from pagewright.functions.core import (
    Sql, contains_any, fold, keep, let, regex, struct, transform, words,
)

# Query parameters that only track a visitor.
TRACKING_PARAMS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "ref", "source", "fbclid", "gclid", "mc_cid", "mc_eid",
]
# Path endings of resource files.
RESOURCE_ENDINGS = [
    ".css", ".js", ".jpg", ".jpeg", ".png", ".gif", ".svg",
    ".webp", ".ico", ".woff", ".woff2", ".ttf", ".eot",
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".zip",
    ".mp3", ".mp4", ".avi", ".mov", ".wav",
]
# Social networks, matched anywhere in the host.
SOCIAL_DOMAINS = [
    "facebook.com", "twitter.com", "x.com", "instagram.com",
    "linkedin.com", "youtube.com", "tiktok.com", "pinterest.com",
    "reddit.com", "whatsapp.com", "t.me", "telegram.org",
]
# Words that mark a link as site navigation.
NAVIGATION_WORDS = [
    "login", "signin", "signup", "register", "logout",
    "cart", "checkout", "account", "profile", "settings",
    "privacy", "terms", "contact", "about", "faq", "help",
    "search", "sitemap", "subscribe", "newsletter",
]
# File extensions of downloads and of media.
DOWNLOAD_EXTENSIONS = ["pdf", "doc", "docx", "xls", "xlsx", "zip", "rar"]
MEDIA_EXTENSIONS = ["jpg", "jpeg", "png", "gif", "mp4", "mp3"]
# Hrefs that are no page links (case matters).
SKIPPED_HREF_STARTS = ["#", "javascript:", "mailto:", "tel:"]
# Schemes that allow relative references.
_RELATIVE_SCHEMES = [
    "", "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https", "shttp", "mms",
    "prospero", "rtsp", "rtsps", "rtspu", "sftp", "svn", "svn+ssh", "ws", "wss",
]

# scheme, authority, path, parameters of the last segment, query, fragment
_URL = (
    r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?"
    r"((?:[^?#]*/)?[^?#;/]*)(?:;([^?#/]*))?(?:\?([^#]*))?(?:#(.*))?$"
)
# What most links and addresses look like: nothing in them has to be decoded, sorted or rewritten.
# No repeated groups: the matcher would need a stack as deep as the path is long.
_PLAIN_PATH = r"[0-9A-Za-z_~/-]*[0-9A-Za-z_~-]"
_PLAIN_HREF = rf"^(?:\.\./)?{_PLAIN_PATH}(?:\?[0-9A-Za-z_=&~.-]+)?\z"
_PLAIN_BASE = r"^/[0-9A-Za-z_~/-]*\z"
_PLAIN_URL = rf"^https?://[0-9a-z.:-]+/{_PLAIN_PATH}\z"
_PLAIN_PAIR = rf"^https?://[0-9a-z.:-]+/{_PLAIN_PATH}\?[0-9A-Za-z_~-]+=[0-9A-Za-z_~.-]*\z"
_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"


def clean_url(url: Sql) -> Sql:
    """Drop leading control characters and blanks, and all tabs and line ends."""
    leading, unclean = r"^[\x00-\x20]+", r"^[\x00-\x20]|[\t\r\n]"
    return (f"if({url} rlike {regex(unclean)}, "
            f"translate(regexp_replace({url}, {regex(leading)}, ''), '\\t\\r\\n', ''), {url})")


def split_url(url: Sql) -> Sql:
    """struct<scheme, netloc, path, params, query, fragment>, '' where absent."""
    # Line ends cannot occur in a cleaned URL, so they can separate the parts.
    parts = (f"split(regexp_replace({clean_url(url)}, {regex(_URL)}, "
             f"'$1\\n$2\\n$3\\n$4\\n$5\\n$6'), '\\n')")
    return let(parts, lambda p: struct(
        scheme=f"lower({p}[0])", netloc=f"{p}[1]", path=f"{p}[2]",
        params=f"{p}[3]", query=f"{p}[4]", fragment=f"{p}[5]"))


def netloc(url: Sql) -> Sql:
    """The authority exactly as written."""
    return f"regexp_extract({clean_url(url)}, {regex(_AUTHORITY)}, 1)"


def hostname(url: Sql) -> Sql:
    """The authority without user information and port, lower case."""
    bare = f"regexp_replace({netloc(url)}, '^.*@', '')"
    return f"lower(regexp_replace({bare}, ':[0-9]*$', ''))"


def has_bad_brackets(authority: Sql) -> Sql:
    """An authority with only one of the two IPv6 brackets cannot be parsed."""
    return f"(contains({authority}, '[') <> contains({authority}, ']'))"


def is_unreadable(url: Sql) -> Sql:
    """Does the address have a bad authority?  Addresses without brackets are not split."""
    return f"((contains({url}, '[') or contains({url}, ']')) and {has_bad_brackets(netloc(url))})"


def build_url(scheme: Sql, authority: Sql, path: Sql, params: Sql, query: Sql, fragment: Sql) -> Sql:
    """The inverse of `split_url`."""
    def assemble(p):
        rooted = f"({p} = '' or startswith({p}, '/'))"
        return f"""concat(
            case when {scheme} <> '' then concat({scheme}, ':') else '' end,
            case when {authority} <> '' then concat('//', {authority}, case when {rooted} then '' else '/' end, {p})
                 when startswith({p}, '//') or ({scheme} <> '' and {rooted}) then concat('//', {p})
                 else {p} end,
            case when {query} <> '' then concat('?', {query}) else '' end,
            case when {fragment} <> '' then concat('#', {fragment}) else '' end)"""

    return let(f"case when {params} <> '' then concat({path}, ';', {params}) else {path} end", assemble)


def _directory(path: Sql) -> Sql:
    """The path up to its last slash."""
    return f"left({path}, length({path}) - length(substring_index({path}, '/', -1)))"


def _merge_path(base_path: Sql, path: Sql) -> Sql:
    """Resolve a relative path against the base path and remove dot segments."""
    repeated = regex(r"^/+|(?<=/)/+")
    directory = _directory(base_path)

    def merge(d):
        # Empty segments collapse only when the two paths are merged.
        return let(f"concat(if({d} = '', '/', {d}), {path})",
                   lambda m: f"if(contains({m}, '//'), concat(left({m}, 1), regexp_replace(substr({m}, 2), {repeated}, '')), {m})")

    def drop_dots(segments):
        done = fold(
            segments, "cast(array() as array<string>)",
            lambda a, s: f"case when {s} = '..' then slice({a}, 1, greatest(size({a}) - 1, 0)) "
                         f"when {s} = '.' then {a} else concat({a}, array({s})) end")
        return (f"array_join(concat({done}, if(element_at({segments}, -1) in ('.', '..'), "
                f"array(''), cast(array() as array<string>))), '/')")

    joined = f"case when startswith({path}, '/') then {path} else {let(directory, merge)} end"
    has_dots = regex(r"(^|/)\.\.?(/|$)")
    return let(joined, lambda p: let(
        f"case when {p} rlike {has_dots} then {let(f'split({p}, {chr(39)}/{chr(39)})', drop_dots)} else {p} end",
        lambda r: f"if({r} = '', '/', {r})"))


def resolve_parts(base: Sql, href: Sql) -> Sql:
    """L2: resolve `href` on a base that `split_url` has already split."""
    def resolve(h):
        scheme = f"if({h}.scheme <> '', {h}.scheme, {base}.scheme)"
        absolute = build_url(scheme, f"{h}.netloc", f"{h}.path", f"{h}.params", f"{h}.query", f"{h}.fragment")
        same_document = build_url(
            scheme, f"{base}.netloc", f"{base}.path", f"{base}.params",
            f"if({h}.query <> '', {h}.query, {base}.query)", f"{h}.fragment")
        relative = build_url(
            scheme, f"{base}.netloc", _merge_path(f"{base}.path", f"{h}.path"),
            f"{h}.params", f"{h}.query", f"{h}.fragment")
        return f"""case
            when {scheme} <> {base}.scheme or {scheme} not in ({words(_RELATIVE_SCHEMES)}) then {href}
            when {h}.netloc <> '' then {absolute}
            when {h}.path = '' and {h}.params = '' then {same_document}
            else {relative} end"""

    # The same for plain links, which need no parts.
    plain = (f"{base}.netloc <> '' and {base}.scheme in ('http', 'https') and {href} rlike {regex(_PLAIN_HREF)} and not contains({href}, '//') "
             f"and (startswith({href}, '/') or {base}.path rlike {regex(_PLAIN_BASE)} and not contains({base}.path, '//'))")
    folder = _directory(f"{base}.path")
    above = f"regexp_replace({folder}, {regex(r'[^/]+/$')}, '')"
    below = (f"case when startswith({href}, '/') then {href} when startswith({href}, '../') then concat({above}, substr({href}, 4)) "
             f"else concat({folder}, {href}) end")
    return f"if({plain}, concat({base}.scheme, '://', {base}.netloc, {below}), {let(split_url(href), resolve)})"


def resolve_url(base: Sql, href: Sql) -> Sql:
    """L2: the absolute form of `href` seen on page `base` (RFC 3986 section 5)."""
    return (f"case when {base} = '' then {href} when {href} = '' then {base} "
            f"else {let(split_url(base), lambda b: resolve_parts(b, href))} end")


def _decode(text: Sql) -> Sql:
    # A percent sign without two hex digits stands for itself.
    lone = regex("%(?![0-9A-Fa-f]{2})")
    return (f"if({text} rlike '[%+]', coalesce(try_url_decode("
            f"regexp_replace({text}, {lone}, '%25')), {text}), {text})")


def query_pairs(query: Sql) -> Sql:
    """array<struct<key, at, value>> sorted by key, first value per key, decoded."""
    def pair(field, at):
        return let(f"split({field}, '=', 2)", lambda kv: struct(
            key=_decode(f"{kv}[0]"), at=at, value=_decode(f"coalesce(get({kv}, 1), '')")))

    fields = keep(f"split({query}, '&')", lambda f: f"{f} <> ''")
    return let(f"sort_array({transform(fields, pair, 2)})", lambda s: keep(
        s, lambda p, i: f"({i} = 0 or get({s}, {i} - 1).key <> {p}.key)", 2))


def strip_tracking_params(query: Sql) -> Sql:
    """Sorted, decoded, tracking-free query string."""
    kept = keep(query_pairs(query), lambda p: f"lower({p}.key) not in ({words(TRACKING_PARAMS)})")
    joined = transform(kept, lambda p: f"concat({p}.key, '=', {p}.value)")
    return f"if({query} = '', '', array_join({joined}, '&'))"


def normalize_url(url: Sql, strip_tracking: bool = True, include_fragments: bool = False) -> Sql:
    """L4: canonical http(s) URL, NULL for every other scheme and for bad authorities."""
    def canonical(p):
        path = (f"case when {p}.path in ('', '/') then '/' when endswith({p}.path, '/') "
                f"then regexp_replace({p}.path, '/+$', '') else {p}.path end")
        query = strip_tracking_params(f"{p}.query") if strip_tracking else f"{p}.query"
        rebuilt = let(query, lambda q: build_url(
            f"{p}.scheme", f"lower({p}.netloc)", path, f"{p}.params", q,
            f"{p}.fragment" if include_fragments else "''"))
        return (f"case when {p}.scheme in ('http', 'https') and not {has_bad_brackets(p + '.netloc')} "
                f"then {rebuilt} end")

    # The same for plain addresses, which need no parts.
    key = f"substring_index(substring_index({url}, '?', -1), '=', 1)"
    bare = f"if(lower({key}) in ({words(TRACKING_PARAMS)}), substring_index({url}, '?', 1), {url})" if strip_tracking else url
    return (f"case when {url} rlike {regex(_PLAIN_URL)} then {url} when {url} rlike {regex(_PLAIN_PAIR)} then {bare} "
            f"else {let(split_url(url), canonical)} end")


def browser_url(url: Sql) -> Sql:
    """An http(s) address as browsers write it: lower-case host, a path of at least ``/``."""
    return let(split_url(url), lambda p: (
        f"if({p}.scheme in ('http', 'https'), "
        + build_url(f"{p}.scheme", f"lower({p}.netloc)", f"if({p}.path = '', '/', {p}.path)",
                    f"{p}.params", f"{p}.query", f"{p}.fragment") + f", {url})"))


def url_path(url: Sql) -> Sql:
    """Path of an absolute URL without the parameters of its last segment."""
    return (f"regexp_replace(regexp_extract({clean_url(url)}, {regex(_PATH)}, 1), "
            f"{regex(';[^/]*$')}, '')")


def is_internal(host: Sql, base_host: Sql) -> Sql:
    """The same host, a subdomain of it, or the same site with or without ``www.``."""
    bare = f"substr({base_host}, 5)"
    return f"""({host} = {base_host} or endswith({host}, concat('.', {base_host}))
        or if(startswith({base_host}, 'www.'),
              {host} = {bare} or endswith({host}, concat('.', {bare})),
              {host} = concat('www.', {base_host})))"""


def link_type(host: Sql, path: Sql, text: Sql) -> Sql:
    """Social, download, media, navigation or content; the first that applies.

    `host` and `path` are lower case."""
    extension = f"if(contains({path}, '.'), substring_index({path}, '.', -1), '')"
    return f"""case
        when {contains_any(host, SOCIAL_DOMAINS)} then 'social'
        when {extension} in ({words(DOWNLOAD_EXTENSIONS)}) then 'download'
        when {extension} in ({words(MEDIA_EXTENSIONS)}) then 'media'
        when {contains_any(f"lower(concat({path}, ' ', {text}))", NAVIGATION_WORDS)} then 'navigation'
        else 'content' end"""


def is_resource(path: Sql) -> Sql:
    """Does the lower-case path end like a resource file?"""
    return "(" + " or ".join(f"endswith({path}, '{ending}')" for ending in RESOURCE_ENDINGS) + ")"


def is_page_href(href: Sql) -> Sql:
    """L1: keep hrefs that can lead to a page."""
    skipped = " or ".join(f"startswith({href}, '{s}')" for s in SKIPPED_HREF_STARTS)
    return f"({href} <> '' and not ({skipped}))"
