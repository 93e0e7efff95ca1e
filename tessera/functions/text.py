"""Functions of texts: concepts, paths, canonical JSON."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The terms of each concept.
CONCEPTS = {
    "night": ("night", "dark", "evening", "夜景", "夜晚", "暗"),
    "bright": ("bright", "daylight", "sunny", "明亮", "白天", "阳光"),
    "warm": ("warm", "orange", "red", "sunset", "暖色", "橙色", "红色", "日落"),
    "cool": ("cool", "blue", "cyan", "冷色", "蓝色", "青色"),
    "green": ("green", "forest", "grass", "绿色", "森林", "草地"),
    "colorful": ("colorful", "vivid", "多彩", "鲜艳"),
    "monochrome": ("monochrome", "black and white", "灰色", "黑白"),
    "high_contrast": ("contrast", "dramatic", "高对比", "戏剧性"),
    "soft": ("soft", "minimal", "柔和", "极简"),
    "architecture": ("architecture", "building", "city", "建筑", "城市"),
    "nature": ("nature", "outdoor", "mountain", "自然", "户外", "山"),
    "sky": ("sky", "cloud", "天空", "云"),
    "food": ("food", "cafe", "meal", "美食", "咖啡", "餐"),
    "landscape": ("landscape", "wide", "风景", "横幅"),
    "portrait": ("portrait", "person", "people", "人像", "人物"),
    "cinematic": ("cinematic", "film", "movie", "电影感", "胶片"),
}


def term_pattern(term: str) -> str:
    """A Latin term stands alone; any other may be anywhere."""
    return f"(^|[^a-z0-9_]){term}([^a-z0-9_]|$)" if term.isascii() else term


def concept_counts(text: Column, concepts: dict[str, tuple[str, ...]] = CONCEPTS) -> Column:
    """How many terms of each concept the text holds; a null text holds none."""
    plain = F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))

    def held(t: Column, term: str) -> Column:
        """A plain search first: few texts hold the term at all."""
        return F.when(F.contains(t, F.lit(term)), t.rlike(term_pattern(term)) if term.isascii() else F.lit(True)).otherwise(False).cast("int")

    count = lambda t: F.array(*(sum((held(t, w) for w in terms), F.lit(0)) for terms in concepts.values()))
    return F.get(F.transform(F.array(plain), count), F.lit(0))  # the lambda's argument: the text is made plain once


def concept_vector(text: Column, concepts: dict[str, tuple[str, ...]] = CONCEPTS) -> Column:
    """concept_counts at length 1; null where no term is known."""
    counts = concept_counts(text, concepts)
    length = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(length > 0, F.transform(counts, lambda x: x / length))


#: Web addresses, which stay, and local paths.
_URL = r"(?i)https?://[^\s\r\n\"'<>]+"
_PATHS = (
    r"(?i)file:///?[^\r\n\"'<>]+",
    r"(?i)(?:[a-z]:[\\/])[^\r\n\"'<>|]*",
    r"(?i)(?:[a-z]:)[^\\/\r\n\"'<>|]+[\\/][^\r\n\"'<>|]*",
    r"(?<![\w:/\\])(?:\\\\|//)[^\r\n\"'<>]+",
    r"(?<![\w\\])\\[^\s\\\"'<>|]{2,}(?:\\[^\s\\\"'<>|]+)*",
    r"(?<![\w])~[\\/][^\r\n\"'<>]*",
    r"(?:\.\.[\\/])+[^\r\n\"'<>|]*",
    r"(?<![:/])(?:[^\s/\\\"'<>]+/){2,}[^\s/\\\"'<>]+",
    r"(?<![\w/])/(?:[^/\r\n\\\"'<>|]+/)+[^\r\n\\\"'<>|]+",
    r"(?i)/(?:[a-z](?=/)|home|users?|usr|var|tmp|temp|etc|opt|mnt|media|srv|root|private|volumes|app|workspace|data|photos?|code|projects?|models?)(?:(?:/[^/\s\\\"'<>]+)+|(?=$|[^a-z0-9_.-]))",
    r"(?<![\w/])/[^\s/\\\"'<>]+(?=$|[\s,.;:!?()\[\]{}])",
    r"(?<![\w/])/(?:[^/\s\\\"'<>]+/)+[^/\s\\\"'<>]+",
    r"(?i)(?<![\w])(?:users?|home|appdata|temp|tmp|cache|\.cache)(?:[\\/][^\s\"'<>]+)+",
)


#: What stands for a path.
MARK = "[path]"


def redacted(text: str, mark: str) -> tuple[str, int]:
    urls = [m.span() for m in re.finditer(_URL, text)]
    hits = {
        m.span() for p in _PATHS for m in re.finditer(p, text)
        if m.end() > m.start() and not all(c.isdecimal() for c in m[0].split("/") if c) and all(m.end() <= a or b <= m.start() for a, b in urls)
    }
    out, end, count = [], 0, 0
    for a, b in sorted(hits):
        if not count or a > end:
            out += [text[end:a], mark]
            count += 1
        end = max(end, b)
    return "".join(out) + text[end:], count


def redact_paths(text: Column, mark: str = MARK) -> Column:
    """struct(text, n): overlapping local paths replaced by one mark; null stays null with n 0.

    Texts without a slash or backslash, most of them, never leave the JVM.
    """

    @F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("n", T.IntegerType())]))
    def scrub(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, 0) if t is None else redacted(t, mark) for t in texts], columns=["text", "n"])

    asked = F.coalesce(text.rlike(r"[/\\]"), F.lit(False))
    done = scrub(F.when(asked, text))
    return F.struct(F.when(asked, done["text"]).otherwise(text).alias("text"), F.when(asked, done["n"]).otherwise(0).alias("n"))


def canonical_sha256(*columns: str) -> Column:
    """SHA-256 of the JSON object of the columns, by name; null fields are left out."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def escaped(text: Column) -> Column:
    """Text in which no markup can open or close: &, < and > as JSON escapes."""
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("\\u0026")), F.lit("<"), F.lit("\\u003c")), F.lit(">"), F.lit("\\u003e"))


def uncovered(request: Column, spans: Column) -> Column:
    """struct(missing, rest): spans that the request does not hold, and the request without the others."""
    found = F.filter(spans, lambda s: F.contains(request, s))
    rest = F.aggregate(found, request, lambda left, s: F.replace(left, s, F.lit(" ")))
    return F.struct(F.filter(spans, lambda s: ~F.contains(request, s)).alias("missing"), F.trim(F.regexp_replace(rest, r" +", " ")).alias("rest"))
