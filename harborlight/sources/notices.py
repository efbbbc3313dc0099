"""Local Notices to Mariners: notices and discrepancies, from landed GeoJSON pages of seven layers."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import from_epoch_ms
from ..functions.text import present
from .common import as_poi, features, place
from .lightlist import number_text

SOURCE, ATTRIBUTION = "uscglnm", "USCG Local Notice to Mariners"


@dataclasses.dataclass(frozen=True)
class Layer:
    kind: str
    poi_type: str
    icon: str
    label: str


# The layers.
LAYERS = {
    "haznav": Layer("notice", "Hazard", "hazard", "Hazard to Navigation"),
    "discfedaid": Layer("discrepancy", "Hazard", "hazard", "Discrepant Federal Aid"),
    "discpriaid": Layer("discrepancy", "Hazard", "hazard", "Discrepant Private Aid"),
    "tmpchange": Layer("discrepancy", "Navigational", "notice-to-mariners", "Temporary Change"),
    "marcon": Layer("notice", "Navigational", "notice-to-mariners", "Marine Construction"),
    "bridge": Layer("notice", "Navigational", "notice-to-mariners", "Bridge Notice"),
    "misc": Layer("notice", "Navigational", "notice-to-mariners", "Marine Safety Notice"),
}
_SHARED = "DECIMAL_LATITUDE:double,DECIMAL_LONGITUDE:double,ESRI_OID:double,ATU:double,WATERWAY_NAME:string,CREATE_DATE:bigint"
PROPERTIES = {
    "notice": _SHARED + ",MSI_UID:double,TITLE:string,MSI_GROUP:string,SUB_CATEGORY:string,TYPE:string,DESCRIPTION:string,MODIFIED_DATE:bigint,"
    "BEGIN_DATE:bigint,END_DATE:bigint",
    "discrepancy": _SHARED + ",LNM_UID:double,ATON_UID:double,LLNR:double,ATON_GROUP:string,NAME:string,DISCREP_STATUS:string,DISCREP_CORR_STATUS:string,"
    "TC_STATUS:string,TC_CORR_STATUS:string,AID_TYPE:string,AID_SUBTYPE:string,COLOR:string,DESCRIPTION_TYPE:string,BNM_NUM:string",
}


def load(spark: SparkSession, path: str, layer: str) -> DataFrame:
    return features(spark, path, PROPERTIES[LAYERS[layer].kind])


def business_id(*columns: str) -> Column:
    """The first number among the columns, else a numeric feature id."""
    return F.coalesce(*(number_text(F.col(c)) for c in columns), number_text(F.col("feature_id").try_cast("double")))


def notice_name(layer: Layer) -> Column:
    water, kind, sub = (present(F.col(c)) for c in ("WATERWAY_NAME", "TYPE", "SUB_CATEGORY"))
    title = F.trim(F.get(F.split(present(F.col("TITLE")), "/"), F.lit(0)))
    pair = lambda what: F.concat(water, F.lit(": "), what)
    return F.coalesce(pair(kind), pair(sub), kind, sub, title, F.lit(layer.label))


def summaries(rows: DataFrame, layer: str) -> DataFrame:
    spec = LAYERS[layer]
    if spec.kind == "notice":
        number, name = business_id("MSI_UID", "ESRI_OID"), notice_name(spec)
        ts = F.coalesce(from_epoch_ms(F.col("MODIFIED_DATE")), from_epoch_ms(F.col("CREATE_DATE")))
    else:
        number, name = business_id("LNM_UID", "ATON_UID", "ESRI_OID"), F.coalesce(present(F.col("NAME")), F.lit(spec.label))
        ts = from_epoch_ms(F.col("CREATE_DATE"))
    return as_poi(
        rows, SOURCE, ATTRIBUTION, id=F.concat(F.lit(layer + "_"), number), type=F.lit(spec.poi_type),
        lat=F.coalesce("DECIMAL_LATITUDE", place(1)), lon=F.coalesce("DECIMAL_LONGITUDE", place(0)), name=name, sk_icon=F.lit(spec.icon), ts=ts,
    )


def notice_lines(description: Column) -> Column:
    """A notice's text: its trimmed lines that aren't empty, with line breaks."""
    lines = F.transform(F.split(description, "\r?\n"), lambda x: F.trim(x))
    return F.array_join(F.filter(lines, lambda x: F.length(x) > 0), "<br>")
