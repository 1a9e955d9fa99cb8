"""Websites (F90-F102): host names, e-mail addresses, liveness, technologies of a captured page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.core import ladder, text_or_null

ROLES = ("info", "contact", "hello", "admin", "sales", "support", "office", "mail", "booking", "reservations")
EMAIL, MAILTO = r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}", r"mailto:([^\"'<>\s?]+)"


def liveness(code: Column, redirected: Column) -> Column:
    return ladder([(F.coalesce(redirected, F.lit(False)), "redirected"), (code.isNull(), "error"), (code.between(200, 399), "live"), (code.between(400, 599), "dead")], "error")


def host(url: Column) -> Column:
    """lower case, without www. and a dot at the end; null unless it has a dot and only host characters."""
    plain = F.trim(url)
    full = F.when(plain.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://"), plain).otherwise(F.concat(F.lit("http://"), plain))
    name = F.lower(F.regexp_extract(full, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    name = F.regexp_replace(F.regexp_replace(name, r"^www\.", ""), r"\.$", "")
    return F.when(name.rlike(r"^[a-z0-9.-]+$") & name.contains("."), name)


def plain_url(url: Column) -> Column:
    """F102: trimmed, without one slash at the end."""
    u = F.trim(F.coalesce(url, F.lit("")))
    return F.when(u.endswith("/") & (F.length(u) > 8) & ~u.endswith("//"), F.regexp_replace(u, "/$", "")).otherwise(u)


def email_domain(address: Column) -> Column:
    domain = F.substring_index(F.lower(F.trim(address)), "@", -1)
    return F.when(address.contains("@") & domain.contains("."), domain)


def candidates(url: Column) -> Column:
    """role addresses at the host; an empty list without one."""
    at = host(url)
    return F.when(at.isNull(), F.array().cast("array<string>")).otherwise(F.array(*[F.concat(F.lit(f"{r}@"), at) for r in ROLES]))


def is_email(address: Column) -> Column:
    return F.coalesce(address.rlike(f"^{EMAIL}$"), F.lit(False))


def emails(html: Column, domain: Column | None = None) -> Column:
    """addresses of a page, mail links first, each once, at the domain if one is given."""
    low = F.lower(F.coalesce(html, F.lit("")))
    found = F.array_distinct(F.concat(F.filter(F.regexp_extract_all(low, F.lit(MAILTO), F.lit(1)), is_email), F.regexp_extract_all(low, F.lit(EMAIL), F.lit(0))))
    return found if domain is None else F.filter(found, lambda a: domain.isNull() | a.endswith(F.concat(F.lit("@"), domain)))


def generator(html: Column) -> Column:
    one = r"(?i)<meta\b[^>]*\bname\s*=\s*[\"']generator[\"'][^>]*\bcontent\s*=\s*[\"']([^\"']+)[\"']"
    two = r"(?i)<meta\b[^>]*\bcontent\s*=\s*[\"']([^\"']+)[\"'][^>]*\bname\s*=\s*[\"']generator[\"']"
    return F.coalesce(text_or_null(F.regexp_extract(html, one, 1)), text_or_null(F.regexp_extract(html, two, 1)))


def scripts(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"(?i)<script\b[^>]*\bsrc\s*=\s*[\"']([^\"']+)[\"'][^>]*>"), F.lit(1))


#: technology | category | evidence, any of it: G generator, H page text, h page text without case, U address, S script address (all patterns), C cookie prefix, = cookie, @header pattern, ! header
_RULES = r"""
WordPress | cms | G:wordpress H:wp-content/ H:wp-includes/ C:wordpress
Drupal | cms | G:drupal @x-generator:drupal H:sites/default/files/ C:ssess
Wix | cms | @server:wix U:wixsite\.com h:X-Wix-Meta-Site-Id H:parastorage\.com
Squarespace | cms | @server:squarespace H:static1\.squarespace\.com =:ss_mid
Webflow | cms | G:webflow @x-powered-by:webflow H:uploads-ssl\.webflow\.com H:data-wf-page
Joomla | cms | G:joomla H:media/joomla/ C:joomla
Adobe Experience Manager | cms | H:/etc\.clientlibs/ H:/content/dam/ C:cq- C:bc-session
Next.js | framework | @x-powered-by:next\.?js !:x-vercel-id H:__NEXT_DATA__ H:_next/static/
React | frontend | H:data-reactroot H:__REACT_DEVTOOLS_GLOBAL_HOOK__ H:__PRELOAD__ H:react-loaded
Vue | frontend | H:__VUE__ H:__VUE_DEVTOOLS_GLOBAL_HOOK__ h:data-v-[a-f0-9]{8}
Angular | frontend | H:ng-version\s*= H:\bng-app\b
jQuery | frontend | H:jquery[/-]\d S:jquery
Bootstrap | frontend | h:bootstrap(\.min)?\.css S:bootstrap
Tailwind CSS | frontend | H:cdn\.tailwindcss\.com h:/tailwind(\.min)?\.css S:tailwind G:tailwind
Shopify | ecommerce | !:x-shopify-stage !:x-shopify-id H:cdn\.shopify\.com H:shopify-checkout-api-token C:_shopify
WooCommerce | ecommerce | h:woocommerce C:woocommerce_ C:wp_woocommerce_
Magento | ecommerce | !:x-magento-cache-debug h:pub/static/.*Magento H:/skin/frontend/ =:x-magento-vary =:form_key
Salesforce Commerce Cloud | ecommerce | @server:demandware H:on/demandware\. C:dw
Vercel | hosting | @server:vercel !:x-vercel-id
Cloudflare | cdn | @server:cloudflare !:cf-ray =:cf_clearance =:__cf_bm
Akamai | cdn | @server:akamai !:x-akamai-transformed =:_abck
Nginx | server | @server:nginx
Apache | server | @server:apache
Google Analytics | analytics | h:googletagmanager\.com/gtag/js\?id=G- h:google-analytics\.com H:\bgtag\s*\( C:_ga_ =:_ga
Google Tag Manager | marketing | h:googletagmanager\.com/gtm\.js
Adobe Experience Platform | marketing | H:assets\.adobedtm\.com C:amcv_
Facebook Pages | marketing | U:facebook\.com H:og:site_name"\s+content="Facebook =:c_user
"""
RULES = [tuple(x.strip() for x in line.split(" | ")) for line in _RULES.strip().splitlines()]
WEIGHTS = {"framework": 25, "cms": 15, "ecommerce": 15, "hosting": 10, "cdn": 10, "analytics": 8, "marketing": 7, "frontend": 5, "security": 5, "server": 3}


def _evidence(rule: str) -> list[tuple[str, str, str]]:
    """(kind, header or '', pattern) for each piece of evidence."""
    out = []
    for piece in rule.split(" "):
        kind, _, pattern = piece.partition(":")
        out.append(("@", kind[1:], pattern) if kind[0] == "@" else (kind, "", pattern))
    return out


def technologies(url: Column, html: Column, headers: Column, cookies: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """array of struct(name, category) in the order of the rules. headers: map with lower-case keys; cookies: array of names."""
    html, url = F.coalesce(html, F.lit("")), F.coalesce(url, F.lit(""))
    made_by, src = generator(html), scripts(html)
    cookies = F.transform(cookies, F.lower)

    def test(kind: str, header: str, pattern: str) -> Column:
        if kind == "G":
            return made_by.rlike("(?i)" + pattern)
        if kind in "HhU":
            return (url if kind == "U" else html).rlike(("" if kind == "H" else "(?i)") + pattern)
        if kind == "S":
            return F.exists(src, lambda s: s.rlike("(?i)" + pattern))
        if kind == "C":
            return F.exists(cookies, lambda c: c.startswith(pattern))
        if kind == "=":
            return F.array_contains(cookies, pattern)
        if kind == "@":
            return headers[header].rlike("(?i)" + pattern)
        return headers[pattern] != ""

    found = []
    for name, category, evidence in rules:
        any_ = F.lit(False)
        for kind, header, pattern in _evidence(evidence):
            any_ = any_ | F.coalesce(test(kind, header, pattern), F.lit(False))
        found.append(F.when(any_, F.struct(F.lit(name).alias("name"), F.lit(category).alias("category"))))
    return F.array_compact(F.array(*found))


def sophistication(techs: Column) -> Column:
    """the weight of each category once, and bonuses; at most 100."""
    names, kinds = F.transform(techs, lambda t: t["name"]), F.transform(techs, lambda t: t["category"])
    has = lambda *n: F.arrays_overlap(names, F.array(*[F.lit(x) for x in n])).cast("int")
    score = F.lit(0)
    for kind, weight in WEIGHTS.items():
        score = score + F.array_contains(kinds, kind).cast("int") * weight
    score = score + has("Next.js") * has("Vercel") * 5 + has("Cloudflare") * 3 + has("Google Analytics", "Google Tag Manager") * 2 + has("React", "Vue", "Angular") * 3
    return F.least(F.lit(100), score)


def first_of(techs: Column, kind: str) -> Column:
    return F.get(F.filter(techs, lambda t: t["category"] == kind), F.lit(0))["name"]


def technologies_sql(url: str, html: str, headers: str, cookies: str) -> str:
    """The same in SQL, for the checks: a list of names. headers: a map; cookies: a list."""
    made_by = f"coalesce(nullif(regexp_extract({html}, '<meta\\b[^>]*\\bname\\s*=\\s*[\"'']generator[\"''][^>]*\\bcontent\\s*=\\s*[\"'']([^\"'']+)[\"'']', 1, 'i'), ''), '')"
    src = f"regexp_extract_all({html}, '<script\\b[^>]*\\bsrc\\s*=\\s*[\"'']([^\"'']+)[\"''][^>]*>', 1, 'i')"

    def test(kind: str, header: str, pattern: str) -> str:
        if kind == "G":
            return f"regexp_matches({made_by}, '{pattern}', 'i')"
        if kind in "HhU":
            return f"regexp_matches({url if kind == 'U' else html}, '{pattern}', '{'c' if kind == 'H' else 'i'}')"
        if kind == "S":
            return f"len(list_filter({src}, lambda s: regexp_matches(s, '{pattern}', 'i'))) > 0"
        if kind == "C":
            return f"len(list_filter({cookies}, lambda c: starts_with(lower(c), '{pattern}'))) > 0"
        if kind == "=":
            return f"len(list_filter({cookies}, lambda c: lower(c) = '{pattern}')) > 0"
        if kind == "@":
            return f"coalesce(regexp_matches({headers}['{header}'], '{pattern}', 'i'), false)"
        return f"coalesce({headers}['{pattern}'] <> '', false)"

    cases = ", ".join(f"CASE WHEN {' OR '.join(test(*e) for e in _evidence(evidence))} THEN '{name}' END" for name, _, evidence in RULES)
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


def sophistication_sql(names: str) -> str:
    kinds: dict[str, list[str]] = {}
    for name, category, _ in RULES:
        kinds.setdefault(category, []).append(name)
    has = lambda *n: f"(CASE WHEN list_has_any({names}, [{', '.join(repr(x) for x in n)}]) THEN 1 ELSE 0 END)"
    parts = [f"{has(*n)} * {WEIGHTS[k]}" for k, n in kinds.items()]
    return "least(100, " + " + ".join([*parts, f"{has('Next.js')} * {has('Vercel')} * 5", f"{has('Cloudflare')} * 3", f"{has('Google Analytics', 'Google Tag Manager')} * 2", f"{has('React', 'Vue', 'Angular')} * 3"]) + ")"
