"""Ledgers from exported files: XML masters, JSON lists and HTML tables.

Each reader takes a text column and gives one row per ledger as
(key columns, ord, name, grp, ...), in the file's order; merging equal names is
``ledgers.merged``. The reading itself is Spark's (``from_xml``, ``from_json``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.functions.scalars import collapsed, normalize_ledger_name, nothing_if_blank, sanitize_xml, without_references

MONEY = "decimal(18,2)"
# Keys that hold lists, names and groups in JSON exports, in the order they are tried.
LIST_KEYS = ("ledgers", "masters", "items", "data", "records")
NAME_KEYS = ("name", "ledger_name", "title", "ledger", "Name", "LEDGERNAME")
GROUP_KEYS = ("group", "parent", "group_name", "Parent", "GROUP")
# Cells that head a table.
HEADERS = ("SL NO", "S.NO", "SR NO", "NAME", "LEDGER NAME", "PARTICULARS", "GROUP", "PARENT", "CLOSING BALANCE", "OPENING BALANCE", "DR/CR", "TOTAL")
NO_STATE = ("ANY", "NOT APPLICABLE")

_LEDGER = (
    "`_NAME` string, `NAME` string, `PARENT` string, `GROUP` string, `OPENINGBALANCE` string, `PARTYGSTIN` string, `LEDSTATENAME` string, `PRIORSTATENAME` string, `STATE` string, "
    "`COUNTRYOFRESIDENCE` string, `OLDCOUNTRYNAME` string, `COUNTRYNAME` string, `PINCODE` string, `OLDPINCODE` string, `GUID` string, "
    "`LANGUAGENAME.LIST` array<struct<`NAME.LIST`:array<struct<`NAME`:array<string>>>>>, `LEDMAILINGDETAILS.LIST` array<struct<`PINCODE`:string,`OLDPINCODE`:string,`STATE`:string,`LEDSTATENAME`:string>>"
)


def _elements(content: Column, tag: str) -> Column:
    """All elements of one name, as text, in the file's order."""
    return F.regexp_extract_all(content, F.lit(rf"(?s)<{tag}(?:\s[^>]*)?(?:/>|>.*?</{tag}>)"), F.lit(0))


def xml_groups(files: DataFrame, content: str = "content", key: str = "file") -> DataFrame:
    """(key, name, parent, guid) of the groups, the first of equal names."""
    each = files.select(key, F.posexplode(_elements(sanitize_xml(F.col(content)), "GROUP")).alias("place", "element"))
    read = each.withColumn("g", F.from_xml("element", "`_NAME` string, `NAME` string, `PARENT` string, `GUID` string"))
    named = read.select(key, "place", collapsed(F.coalesce(nothing_if_blank(F.col("g._NAME")), F.col("g.NAME"))).alias("name"), nothing_if_blank(F.col("g.PARENT")).alias("parent"), nothing_if_blank(F.col("g.GUID")).alias("guid"))
    first = named.where("name <> ''").groupBy(key, "name").agg(F.min_by(F.struct("parent", "guid"), "place").alias("g"))
    return first.select(key, "name", "g.parent", "g.guid")


def xml_masters(files: DataFrame, content: str = "content", key: str = "file") -> DataFrame:
    """One row per ledger element: name, group and its parent, opening balance, tax number, state, country, pin code, guid, aliases.

    A file without ledger elements gives its LEDGERNAME and MASTERNAME texts.
    """
    clean = files.select(key, sanitize_xml(F.col(content)).alias("xml"))
    each = clean.select(key, F.posexplode(_elements(F.col("xml"), "LEDGER")).alias("ord", "element")).withColumn("l", F.from_xml("element", _LEDGER))
    t = lambda c: nothing_if_blank(F.col(f"l.{c}"))
    mail = F.get(F.col("l.`LEDMAILINGDETAILS.LIST`"), F.lit(0))
    state = lambda c: F.when(~F.upper(F.trim(c)).isin(*NO_STATE), nothing_if_blank(c))
    country = lambda c: F.when(t(c) != "+91", t(c))
    told = F.flatten(F.transform(F.flatten(F.transform(F.coalesce(F.col("l.`LANGUAGENAME.LIST`"), F.array()), lambda x: F.coalesce(x["NAME.LIST"], F.array()))), lambda x: F.coalesce(x["NAME"], F.array())))
    others = F.filter(F.transform(told, collapsed), lambda x: x != "")
    name = collapsed(F.coalesce(t("_NAME"), t("NAME"), F.get(others, F.lit(0))))
    read = each.select(
        key, "ord", name.alias("name"), F.coalesce(t("PARENT"), t("GROUP"), F.lit("Primary")).alias("grp"),
        F.replace(t("OPENINGBALANCE"), F.lit(","), F.lit("")).try_cast(MONEY).alias("opening_balance"), t("PARTYGSTIN").alias("gstin"),
        F.coalesce(*[state(F.col(f"l.{c}")) for c in ("LEDSTATENAME", "PRIORSTATENAME", "STATE")], state(mail["STATE"]), state(mail["LEDSTATENAME"])).alias("state"),
        F.coalesce(country("COUNTRYOFRESIDENCE"), country("OLDCOUNTRYNAME"), country("COUNTRYNAME")).alias("country"),
        F.coalesce(t("PINCODE"), t("OLDPINCODE"), nothing_if_blank(mail["PINCODE"]), nothing_if_blank(mail["OLDPINCODE"])).alias("pincode"), t("GUID").alias("guid"),
        F.array_distinct(F.filter(others, lambda x: F.upper(x) != F.upper(name))).alias("aliases"),
    )
    flat = clean.where(~F.col("xml").rlike(r"<LEDGER[\s>/]")).select(key, F.posexplode(F.regexp_extract_all("xml", F.lit(r"<(?:LEDGERNAME|MASTERNAME)[^>]*>([^<]*)<"), F.lit(1))).alias("ord", "text"))
    plain = flat.select(key, "ord", collapsed(F.col("text")).alias("name"), F.lit("Primary").alias("grp"))
    parents = xml_groups(files, content, key).where("parent IS NOT NULL").select(key, F.col("name").alias("grp"), "parent")
    return read.unionByName(plain, allowMissingColumns=True).where("name <> ''").join(parents, [key, "grp"], "left").withColumn("parent_group", F.coalesce("parent", "grp")).drop("parent")


def _first_key(item: Column, keys: tuple[str, ...]) -> Column:
    return F.coalesce(*[nothing_if_blank(F.get_json_object(item, f"$.{k}")) for k in keys])


def json_ledgers(files: DataFrame, content: str = "content", key: str = "file") -> DataFrame:
    """(key, ord, name, grp) of a list of names or objects, of an object that holds such a list, or of a map from name to group."""
    text = F.trim(content)
    lists = F.coalesce(F.when(text.startswith("["), text), *[F.when(F.get_json_object(text, f"$.{k}").startswith("["), F.get_json_object(text, f"$.{k}")) for k in LIST_KEYS])
    items = F.from_json(lists, "array<string>")
    entries = F.map_entries(F.from_json(text, "map<string,string>"))
    as_items = F.transform(items, lambda x: F.struct(F.when(x.startswith("{"), _first_key(x, NAME_KEYS)).otherwise(F.trim(x)).alias("name"), F.when(x.startswith("{"), _first_key(x, GROUP_KEYS)).alias("grp")))
    as_map = F.transform(entries, lambda x: F.struct(x["key"].alias("name"), F.when(x["value"].startswith("{"), F.get_json_object(x["value"], "$.group")).otherwise(nothing_if_blank(x["value"])).alias("grp")))
    # An empty list falls through to the map, as a wrapped one does.
    chosen = F.when((F.size(items) > 0) | text.startswith("["), as_items).otherwise(as_map)
    each = files.select(key, F.posexplode(chosen).alias("ord", "x"))
    return _first_of_name(each.select(key, "ord", collapsed(F.col("x.name")).alias("name"), F.coalesce("x.grp", F.lit("Primary")).alias("grp")), key)


def html_ledgers(files: DataFrame, content: str = "content", key: str = "file") -> DataFrame:
    """(key, ord, name, grp) of table rows; header rows are skipped, a serial number before the name too."""
    rows = files.select(key, F.posexplode(F.regexp_extract_all(content, F.lit(r"(?is)<tr[^>]*>(.*?)(?=</tr>|<tr|</table>|\z)"), F.lit(1))).alias("ord", "row"))
    plain = lambda c: without_references(F.regexp_replace(c, "<[^>]*>", ""))
    cells = F.filter(F.transform(F.regexp_extract_all("row", F.lit(r"(?is)<t[dh][^>]*>(.*?)(?=</t[dh]>|<t[dh]|\z)"), F.lit(1)), lambda c: F.trim(plain(c))), lambda c: c != "")
    got = rows.withColumn("cells", cells).where(F.size("cells") > 0)
    joined = F.upper(F.array_join("cells", " "))
    at = lambda i: F.get("cells", F.lit(i))
    numbered = at(0).rlike("^[0-9]+$") & (F.size("cells") > 1)
    amount = F.regexp_replace(at(1), "[,.]", "").rlike("^[0-9]+$")
    name = F.when(numbered, at(1)).otherwise(at(0))
    group = F.when(numbered, at(2)).otherwise(F.when(~amount, at(1)))
    kept = got.where(~joined.contains("LEDGER NAME") & ~joined.contains("PARTICULARS") & ~F.upper(name).isin(*HEADERS) & (F.length(name) > 1))
    return _first_of_name(kept.select(key, "ord", collapsed(name).alias("name"), F.coalesce(nothing_if_blank(group), F.lit("Primary")).alias("grp")), key)


def _first_of_name(rows: DataFrame, key: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(key, normalize_ledger_name(F.col("name"))).orderBy("ord"))
    return rows.where("name <> ''").withColumn("place", place).where("place = 1").drop("place")
