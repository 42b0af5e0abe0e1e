"""Column expressions shared by the jobs. All are built-in functions, inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The separators that names are compared without.
SEPARATORS = " \t\n\r·•-_.,，。（）()[]{}\"'"
# Words for the two kinds of relation, and predicates that tell of an event.
STATE_WORDS = ("state", "static", "persistent", "stative", "status", "静态", "状态", "持续", "事实")
EVENT_WORDS = ("event", "dynamic", "action", "incident", "动态", "事件", "动作", "言语", "一次")
EVENT_VERBS = ("指责", "警告", "宣布", "否认", "回应", "制裁", "起诉", "逮捕", "调查", "袭击", "攻击", "签署", "批准", "通过", "驳回", "解雇", "任命", "收购", "合作", "谈判", "会见", "访问", "驱逐", "抗议")
# Parts of names that tell an entity's type.
GEO_PARTS = ("市", "省", "州", "县", "区", "镇", "乡", "郡", "岛", "府", "道", "自治", "共和国", "王国", "特区", "自治区")
ORG_PARTS = ("公司", "集团", "银行", "政府", "部", "局", "署", "院", "厅", "行", "党", "机构", "法院", "检察院", "委员会", "组织", "联盟", "理事会", "协会", "基金会", "大学", "学院", "学校", "工厂", "厂", "报", "电视", "新闻", "日报", "晚报", "周报", "社")
PRODUCT_PARTS = ("系列", "版", "型", "型号", "Pro", "Ultra")
# Marks of a passive role.
PASSIVE = ("被", "受", "遭")
PRECISION = ("unknown", "relative", "date", "exact")


def _key(prefix: str, *parts: Column) -> Column:
    return F.sha1(F.concat(F.lit(prefix), F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])))


def entity_id(name: Column) -> Column:
    return F.sha1(F.concat(F.lit("ent:"), F.trim(name)))


def event_id(abstract: Column) -> Column:
    return F.sha1(F.concat(F.lit("evt:"), F.trim(abstract)))


def source_id(name: Column) -> Column:
    return F.sha1(F.concat(F.lit("src:"), name))


def entity_mention_id(name: Column, ts: Column, source: Column) -> Column:
    return _key("ent_mention:", name, ts, source)


def event_mention_id(abstract: Column, ts: Column, source: Column) -> Column:
    return _key("evt_mention:", abstract, ts, source)


def backfill_mention_id(ident: Column, ts: Column, source: Column) -> Column:
    return _key("ent_mention_backfill:", ident, ts, source)


def state_id(*parts: Column) -> Column:
    """parts: subject, predicate, object, from, to, text, algorithm, revision."""
    return _key("rel_state:", *parts)


def observation_id(*parts: Column) -> Column:
    """parts: event, field, text, json, model, version, algorithm, revision."""
    return _key("obs:", *parts)


def payload_hash(payload: Column) -> Column:
    return F.sha1(F.concat(F.lit("payload:"), payload))


def global_id(source: Column, ident: Column) -> Column:
    return F.concat_ws(":", source, ident)


def ts_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def normalize_name(name: Column) -> Column:
    """Lower case, without separators: what names are compared and blocked by."""
    return F.translate(F.lower(F.trim(F.coalesce(name, F.lit("")))), SEPARATORS, "")


def normalize_alnum(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"(?U)[^\w]", ""))


def is_chinese(text: Column) -> Column:
    return text.rlike("[\\u4e00-\\u9fff]")


def _any(text: Column, parts: tuple[str, ...]) -> Column:
    return text.rlike("|".join(parts))


def entity_type(name: Column) -> Column:
    """geo, org, person, product or unknown, by parts of the name."""
    return (
        F.when(_any(name, GEO_PARTS), "geo").when(_any(name, ORG_PARTS), "org").when(name.rlike("[ ·]"), "person").when(_any(name, PRODUCT_PARTS), "product").otherwise("unknown")
    )


def relation_kind(kind: Column, predicate: Column) -> Column:
    """The given kind in one of its spellings, else told from the predicate; empty without either."""
    k = F.lower(F.trim(F.coalesce(kind, F.lit(""))))
    p = F.trim(F.coalesce(predicate, F.lit("")))
    return F.when(k.isin(*STATE_WORDS), "state").when(k.isin(*EVENT_WORDS), "event").when(p == "", "").when(_any(p, EVENT_VERBS), "event").otherwise("state")


def event_time(start: Column, reported: Column, first_seen: Column) -> Column:
    """The start, else the report, else the first sight; blanks count as missing."""
    return F.coalesce(*[F.nullif(F.trim(c.cast("string")), F.lit("")) for c in (start, reported, first_seen)])


def parse_datetime(text: Column) -> Column:
    """A timestamp from any of the formats that feeds use (UTC if no zone is given), else null."""
    formats = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyyMMddHHmmss", "yyyy-MM-dd")
    return F.coalesce(*[F.try_to_timestamp(F.trim(text), F.lit(f)) for f in formats])


def yyyymmdd(text: Column) -> Column:
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.translate(F.substring(text, 1, 10), "-", ""))


def precision_rank(precision: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, PRECISION)), F.coalesce(precision, F.lit("unknown")))


def passive_role(roles: Column) -> Column:
    return F.exists(roles, lambda r: _any(r, PASSIVE))


def first_per(items: Column, key: str) -> Column:
    """The structs of an array, the first of each key, in order."""
    keys = F.transform(items, lambda x: x[key])
    return F.filter(items, lambda x, i: F.array_position(keys, x[key]) == i + 1)


def merged_roles(a: Column, b: Column) -> Column:
    """Two maps name -> roles as one, roles united in order."""
    empty = F.array().cast("array<string>")
    return F.map_zip_with(a, b, lambda _, x, y: F.array_distinct(F.concat(F.coalesce(x, empty), F.coalesce(y, empty))))


def source_list(items: Column) -> Column:
    """Sources as structs of id, name and url, the first of each id.

    items are names, or structs of id, name and url, any of which may be missing: a name stands in for a missing id, as
    its hash, and an id for a missing name. Sources with neither go.
    """
    some = lambda c: F.coalesce(F.trim(c), F.lit(""))

    def one(x: Column) -> Column:
        ident, name, url = some(x["id"]), some(x["name"]), some(x["url"])
        name = F.when(name == "", ident).otherwise(name)
        return F.struct(F.when(ident == "", source_id(name)).otherwise(ident).alias("id"), name.alias("name"), url.alias("url"))

    whole = F.filter(F.transform(items, one), lambda x: x["name"] != "")
    return first_per(whole, "id")


def named_sources(names: Column) -> Column:
    """A list of names as a source list."""
    none = F.lit(None).cast("string")
    return source_list(F.transform(names, lambda n: F.struct(none.alias("id"), n.alias("name"), none.alias("url"))))
