"""URL columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted schemes, wiki addresses, hosts of Chinese sites, mojibake pattern.
SCHEMES = r"^(http://|https://|record:|bbc:)"
WIKI = "https://en.wikipedia.org"
CHINESE_TLDS = [".cn", ".com.cn"]
CHINESE_HOSTS = [
    "baidu.com", "zhihu.com", "bilibili.com", "csdn.net", "jianshu.com", "douban.com", "sina.com",
    "sohu.com", "qq.com", "taobao.com", "jd.com", "163.com", "weibo.com",
]
MOJIBAKE = r"[åèçäéêëì][^\x{4e00}-\x{9fff}\p{L}\p{N}_\s,.!?;:，。！？；：]{2,5}"


def valid_url(col: Column) -> Column:
    return F.coalesce(col.rlike(SCHEMES), F.lit(False))


def netloc(col: Column) -> Column:
    """Authority part between ``//`` and the path; '' when there is none."""
    return F.regexp_extract(col, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def host(col: Column) -> Column:
    """Authority without ``www.``; the input itself when it has none."""
    h = F.replace(netloc(col), F.lit("www."), F.lit(""))
    return F.when(h == "", col).otherwise(h)


def is_chinese_url(col: Column) -> Column:
    """Host under .cn, or one of the well-known Chinese sites."""
    h = F.lower(F.regexp_replace(F.regexp_replace(netloc(col), r"^[^@]*@", ""), r":[0-9]*$", ""))
    test = F.lit(False)
    for ending in [*CHINESE_TLDS, *CHINESE_HOSTS]:
        test = test | h.endswith(ending)
    return test


def has_mojibake(col: Column) -> Column:
    """At least three garbled sequences in the first 500 characters (that window is the rule)."""
    return F.regexp_count(F.substring(col, 1, 500), F.lit(MOJIBAKE)) >= 3


def query_param(url: Column, name: str) -> Column:
    """First decoded value of a query parameter; null when absent or blank."""
    raw = F.regexp_extract(url, rf"\?(?:[^#]*?&)?{name}=([^&#]*)", 1)
    return F.when(raw == "", F.lit(None)).otherwise(F.coalesce(F.try_url_decode(raw), raw))


def history_url(title: Column) -> Column:
    """Revision-history address of an article title; ``/`` stays, blanks become ``_``."""
    coded = F.url_encode(F.replace(title, F.lit(" "), F.lit("_")))
    for code, plain in [("+", "%20"), ("%2F", "/"), ("*", "%2A"), ("%7E", "~")]:
        coded = F.replace(coded, F.lit(code), F.lit(plain))
    return F.concat(F.lit(f"{WIKI}/w/index.php?title="), coded, F.lit("&action=history&offset=&limit=2000"))


def revision_to_current(url: Column) -> Column:
    """Address of the current article for a revision address; null without a title."""
    title = query_param(url, "title")
    scheme = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    return F.concat(scheme, F.lit("://"), netloc(url), F.lit("/wiki/"), title)


def clean_revision_url(href: Column) -> Column:
    """Absolute revision address with title and oldid only; null without an oldid."""
    full = F.when(href.startswith("/"), F.concat(F.lit(WIKI), href)).otherwise(href)
    oldid, title = query_param(full, "oldid"), query_param(full, "title")
    with_title = F.concat(F.lit(f"{WIKI}/w/index.php?title="), title, F.lit("&oldid="), oldid)
    return F.coalesce(with_title, F.concat(F.lit(f"{WIKI}/w/index.php?oldid="), oldid))


def fix_revision_url(url: Column, oldid: Column) -> Column:
    """Turn a diff address into the plain revision address; others pass through."""
    title = F.regexp_extract(url, r"title=([^&]*)", 1)
    return (
        F.when(F.contains(url, F.lit("oldid=")) & F.contains(url, F.lit("title=")),
               F.concat(F.lit(f"{WIKI}/w/index.php?title="), title, F.lit("&oldid="), oldid))
        .when(F.contains(url, F.lit("oldid=")), F.concat(F.lit(f"{WIKI}/w/index.php?oldid="), oldid))
        .otherwise(url)
    )


def url_hash(url: Column) -> Column:
    return F.md5(url)


def store_key(url: Column) -> Column:
    return F.sha2(url, 256)


def legacy_key(url: Column) -> Column:
    """Last path segment, the key older page stores used."""
    return F.element_at(F.split(F.regexp_replace(url, r"/+$", ""), "/"), -1)
