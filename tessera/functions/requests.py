"""Hard constraints in request texts, Chinese and English, as column expressions.

A bounded grammar: spans that were understood are taken out of the text before the next kind is looked for, and a
hard condition that nothing understands is an error, never ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The grammar. Group 1 is the number, group 2 the category or label; (?U) makes classes and \b Unicode.
NUMERALS = "零一二三四五六七八九"
CATEGORY = r"(?U)([\d零一二两三四五六七八九十]+)\s*张\s*(人像|人物|人|风景|景观)(?:照片|照)?(?=$|[\s,，。;；、和与+]|[\d零一二两三四五六七八九十])"
PORTRAITS = ("人像", "人物", "人")
INEXACT_2, INEXACT_3 = "至少|最少|最多|不要|排除|不含", "不超过|不低于"
PERSONS = (
    r"(?iU)至少\s*(\d+)\s*张(?:照片)?(?:有|包含)(我|Me)(?=$|[\s,，。;；、]|且|并)",
    r'(?U)至少\s*(\d+)\s*张(?:照片)?(?:有|包含)[“"]([^”"]{1,80})[”"]',
    r"(?iU)\bat\s+least\s+(\d+)\s+photos?\s+(?:with|of)\s+(me)\b",
    r'(?iU)\bat\s+least\s+(\d+)\s+photos?\s+(?:with|of)\s+"([^"\n]{1,80})"',
)
COUNTS = (r"(?U)(?:选|挑|找|保留)\s*(\d+)\s*(?:张|幅)", r"(?iU)\b(\d+)\s*(?:photos?|images?|shots?)\b")
QUALITIES = (r"(?U)质量\s*(?:>=|≥|不低于|至少)\s*(\d+(?:\.\d+)?)", r"(?iU)\bquality\s*(?:>=|≥|at\s+least)\s*(\d+(?:\.\d+)?)")
GROUPS = (r"(?U)(?:每个)?相似(?:组|照片)?(?:最多|不超过)\s*(\d+)\s*张?", r"(?iU)\bmax(?:imum)?\s+(\d+)\s+(?:per\s+)?similar(?:ity)?\s+group\b")
UNKNOWN_CATEGORY = r"(?U)[\d零一二两三四五六七八九十]+\s*张\s*(?:建筑|自拍|动物|宠物|食物|美食)"
UNKNOWN_CONDITION = (
    r"(?iU)(?:至少|最少|不低于|不超过|最多|恰好|正好)\s*[\d一二三四五六七八九十两]+\s*张|"
    r"(?:不要|禁止|排除|不含|不能|不允许)\s*(?:有|包含|出现)?\s*(?:自拍|人物|人像|人脸|人|我)|"
    r"\b(?:at\s+least|at\s+most|exactly)\s+\d+\s+photos?\s+(?:of|with)|\b(?:no|exclude|without)\s+(?:selfies|people|portraits)\b"
)
WITH_REJECTS = r"(?iU)允许(?:模糊|废片|低质量)|包含(?:模糊|废片|低质量)|\binclude\s+(?:rejects?|blurry|low[- ]quality)\b"
DIFFERENT_PEOPLE = "不同的人"
SLIP, TAKEN_OUT = r"(?U)((?:挑|选|找)\s*\d+\s*)长(?=\s*\S)", r"(?U)(挑|选|找)出(?=\s*\d+\s*张)"
TOTAL_IN_NUMERALS = r"(?U)(?:选|挑|找|保留)(?:出)?\s*[零一二两三四五六七八九十]+\s*张"
DESCRIBED_TOTAL = r"(?U)(?:挑|选|找|保留)(?:出)?[^\d，,。;；\n]{1,60}的\s*(\d+)\s*张(?:照片|图片)(?=$|[\s，,。;；！!])"
FILLER = r"(?iU)\b(?:pick|select|choose|find|keep|of|with|and|please)\b|(?:请|帮我|选择|选|挑|找|保留|照片|图片)"
PUNCTUATION = r"(?U)[\s,，。.!！?？;；:：、]+"
MOST_ITEMS, MOST_PER_GROUP, DEFAULT_ITEMS = 50, 10, 12
#: Numbers too long for a long; more than any bound.
_HUGE = 10**9


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _gone(text: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, p, " "), patterns, text)


def _whole(digits: Column) -> Column:
    return F.coalesce(digits.try_cast("long"), F.lit(_HUGE)).cast("long")


def _first(text: Column, patterns: tuple[str, ...]) -> Column:
    """Group 1 of the first pattern that matches; null if none does."""
    return F.coalesce(*(F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns))


def collapsed(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends, full-width digits as ASCII ones."""
    return F.translate(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), "０１２３４５６７８９", "0123456789")


def numeral(text: Column) -> Column:
    """The value of digits or of a Chinese numeral up to 99; null if it is neither."""
    one = lambda t: F.when(t == "两", 2).when(t != "", F.nullif(F.instr(F.lit(NUMERALS), t), F.lit(0)) - 1)
    tens, ones = F.substring_index(text, "十", 1), F.substring(text, F.instr(text, "十") + 1, F.length(text))
    with_ten = F.when((F.length(tens) <= 1) & (F.length(ones) <= 1), F.coalesce(one(tens), F.lit(1)) * 10 + F.coalesce(one(ones), F.lit(0)))
    return F.when(text.rlike(r"^[0-9]+$"), _whole(text)).when(text.contains("十"), with_ten).when(F.length(text) == 1, one(text)).cast("long")


def normalized_request(text: Column) -> Column:
    """The request with plain slips mended and the total that a command names in Chinese numerals as digits."""
    mended = F.regexp_replace(F.regexp_replace(collapsed(text), SLIP, "$1张"), TAKEN_OUT, "$1")

    def in_digits(now: Column, span: Column) -> Column:
        value = numeral(F.regexp_extract(span, r"([零一二两三四五六七八九十]+)\s*张$", 1))
        verb = F.regexp_extract(span, "^(选|挑|找|保留)", 1)
        return F.when(value.isNotNull(), F.replace(now, span, F.concat(verb, value.cast("string"), F.lit("张")))).otherwise(now)

    whole = F.aggregate(F.array_distinct(_all(mended, TOTAL_IN_NUMERALS, 0)), mended, in_digits)
    rest = F.regexp_replace(whole, CATEGORY, " ")
    described = F.regexp_extract(rest, DESCRIBED_TOTAL, 1)
    stated = reduce(lambda a, b: a | b, (rest.rlike(p) for p in COUNTS))
    return F.when(~stated & (described != ""), F.concat(F.lit("选"), described, F.lit("张。"), whole)).otherwise(whole)


def extract_constraints(requests: DataFrame, text: str = "text") -> DataFrame:
    """requests with target_count, min_quality, max_per_group, exclude_rejects, person_minimums, category_counts and error.

    error is null or the first of: empty, different_people, inexact_category, category_number, category_conflict,
    person_minimum, unknown_category, unknown_condition, total_conflict, total, quotas, min_quality, max_per_group;
    where it is set the other columns are null, so a conflict is never a default. Without a total it is the sum of
    the category counts, or 12. A null text is empty; a label is trimmed, in lower case and "me" for the speaker;
    of two minimums for one label the larger holds. Repeated rows are rows of their own.
    """
    taken = {"target_count", "min_quality", "max_per_group", "exclude_rejects", "person_minimums", "category_counts", "error"} & set(requests.columns)
    if taken:
        raise ValueError(f"columns {sorted(taken)} are taken")
    c = F.col
    d = requests.select(F.struct(*(c(f"`{x}`") for x in requests.columns)).alias("_row"), collapsed(F.coalesce(c(text), F.lit(""))).alias("_text"))
    inexact = f"(?:(?<=(?:{INEXACT_2}).{{0,6}})|(?<=(?:{INEXACT_3}).{{0,5}})){CATEGORY.removeprefix('(?U)')}"
    kind = lambda x: F.when(x.isin(*PORTRAITS), "portrait").otherwise("landscape")
    wanted = F.zip_with(_all(c("_text"), CATEGORY, 1), _all(c("_text"), CATEGORY, 2), lambda n, k: F.struct(kind(k).alias("k"), numeral(n).alias("n")))
    d = d.withColumns({"_wanted": F.array_distinct(wanted), "_rest": F.regexp_replace("_text", CATEGORY, " ")})

    people, rest = [], c("_rest")
    for pattern in PERSONS:
        named = lambda n, who: F.struct(F.when(F.trim(who).isin("我", "本人"), "me").otherwise(F.lower(F.trim(who))).alias("k"), _whole(n).alias("n"))
        people.append(F.zip_with(_all(rest, pattern, 1), _all(rest, pattern, 2), named))
        rest = F.regexp_replace(rest, pattern, " ")
    d = d.withColumns({"_people": F.concat(*people), "_plain": rest})
    d = d.withColumn("_ungrouped", _gone(c("_plain"), GROUPS))
    totals = F.array_distinct(F.transform(F.concat(*(_all(c("_plain"), p) for p in COUNTS)), _whole))
    d = d.withColumns({"_totals": totals, "_sum": F.aggregate("_wanted", F.lit(0).cast("long"), lambda a, w: a + F.coalesce(w["n"], F.lit(0)))})
    d = d.withColumns({
        "_target": F.coalesce(F.get("_totals", F.lit(0)), F.nullif(c("_sum"), F.lit(0)), F.lit(DEFAULT_ITEMS)),
        "_quality": F.coalesce(_first(c("_text"), QUALITIES).try_cast("double"), F.lit(0.0)), "_cap": F.coalesce(_whole(F.nullif(F.coalesce(_first(c("_text"), GROUPS), F.lit("1")), F.lit(""))), F.lit(1)),
    })
    kinds = F.transform("_wanted", lambda w: w["k"])
    between = lambda x, low, high: (x >= low) & (x <= high)
    error = (
        F.when(c("_text") == "", "empty").when(c("_text").contains(DIFFERENT_PEOPLE), "different_people").when(c("_text").rlike(f"(?U){inexact}"), "inexact_category")
        .when(F.exists("_wanted", lambda w: ~F.coalesce(between(w["n"], 0, MOST_ITEMS), F.lit(False))), "category_number")
        .when(F.size(kinds) > F.size(F.array_distinct(kinds)), "category_conflict")
        .when(F.exists("_people", lambda p: (p["k"] == "") | ~between(p["n"], 1, MOST_ITEMS)), "person_minimum")
        .when(_gone(c("_ungrouped"), COUNTS).rlike(UNKNOWN_CATEGORY), "unknown_category").when(c("_ungrouped").rlike(UNKNOWN_CONDITION), "unknown_condition")
        .when(F.size("_totals") > 1, "total_conflict").when(~between(c("_target"), 1, MOST_ITEMS), "total")
        .when((c("_sum") > c("_target")) | ((F.size("_wanted") == 2) & (c("_sum") != c("_target"))), "quotas")
        .when(~between(c("_quality"), 0, 100), "min_quality").when(~between(c("_cap"), 1, MOST_PER_GROUP), "max_per_group")
    )
    d = d.withColumn("error", error)
    fine = c("error").isNull()
    of = lambda name: F.array_sort(F.array_distinct(F.transform(name, lambda p: p["k"])))
    most = F.transform(of("_people"), lambda k: F.struct(k, F.array_max(F.transform(F.filter("_people", lambda p: p["k"] == k), lambda p: p["n"])).cast("int")))
    counts = F.transform(F.array_sort("_wanted"), lambda w: F.struct(w["k"], w["n"].cast("int")))
    return d.select(
        "_row.*", F.when(fine, c("_target").cast("int")).alias("target_count"), F.when(fine, c("_quality")).alias("min_quality"), F.when(fine, c("_cap").cast("int")).alias("max_per_group"),
        F.when(fine, ~c("_text").rlike(WITH_REJECTS)).alias("exclude_rejects"), F.when(fine, F.map_from_entries(most)).alias("person_minimums"),
        F.when(fine, F.map_from_entries(counts)).alias("category_counts"), "error",
    )


def has_semantic_content(text: Column) -> Column:
    """Whether anything is left of a request without its constraints, filler and punctuation."""
    rest = _gone(collapsed(F.coalesce(text, F.lit(""))), (*PERSONS, *COUNTS, *QUALITIES, *GROUPS, WITH_REJECTS, FILLER))
    return F.regexp_replace(rest, PUNCTUATION, "") != ""
