"""Recodings of record columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftline.functions import rsem
from driftline.functions.rsem import ColumnLike, _c

# --- fixed values: category texts of the record table and their groups -------------

HABITAT_GROUPS = {
    "demersal": ["demersal", "reef-associated", "benthopelagic", "bathydemersal"],
    "pelagic": ["pelagic-neritic", "pelagic-oceanic", "mesopelagic", "bathypelagic"],
}

PROVINCE_REPAIRS = {"BPRL": "BPLR", "HUMB": "CHIL", "NAST E": "NASE", "NPSE": "NPPF"}

FAMILY_REPAIRS = {"Gasterostediae": "Gasterosteidae", "Merluccidae": "Merlucciidae"}

DUPLICATE_STUDIES = ("Sun et al. 2019",)

GEAR_GROUPS = {
    "bottom trawls": [
        "bottom trawls, trammel fishing", "bottom trawls", "bottom trawls, aquaculture",
        "bottom trawls, purse seine",
    ],
    "fish market": [
        "fish market", "fish market, bycatch", "fish market, field collection",
        "fish market, fishermen",
    ],
    "gillnets": [
        "fyke nets, gillnets", "gillnets", "gillnets, purse seine", "gillnet, fish market",
    ],
    "lines incld. longlines": ["longline", "line", "nets, hook-and-line", "trolling lines"],
    "trawling": [
        "trawling", "beam trawl", "fyke nets, trawling", "otter trawl, trawling, longline",
        "semi-pelagic trawls", "otter trawl", "nets, trawling", "otter trawl, fyke nets",
        "pelagic trawl", "trawling, bycatch", "pelagic trawl, bottom trawls", "rapido trawl",
        "shrimp nets",
    ],
    "seines": ["purse seine", "beach seine"],
}

CAPTURE_GROUPS = {
    "aquaculture": ["Aquaculture", "plastic study, aquaculture"],
    "small scale fishing": [
        "artisanal fishing", "recreational fishing", "artisanal fishing, fish market",
        "plastic study, artisanal fishery",
    ],
    "bycatch": ["bycatch", "incidental"],
    "plastic study": [
        "plastic study (not listed)", "plastic study", "plastic study, commercial fishing",
        "plastic study, fish market", "plastic study, commercial fishing, recreational fishing",
    ],
}

COMMERCIAL_GROUPS = {
    "Commercial": ["commercial", "highly commercial"],
    "Minor": ["minor commercial", "subsistence"],
    "None": ["none"],
}
COMMERCIAL_GROUPS_WIDE = {**COMMERCIAL_GROUPS,
                          "Minor": ["minor commercial", "subsistence", "subsistence fisheries"]}

COMMERCIAL_VALUES = ("commercial", "highly commercial")
THREATENED = ("NT", "VU", "EN", "CR")
UNNAMED_SPECIES = ("sp.", "spp.", "spp")

COASTAL_PROVINCES = (
    "ALSK", "CCAL", "CAMR", "BERS", "BPLR", "CARB", "CHIL", "FKLD", "BRAZ", "APLR", "EAFR",
    "BENG", "GUIN", "NWCS", "CNRY", "MEDI", "NECS", "SARC", "REDS", "ARAB", "INDW", "INDE",
    "AUSW", "SUND", "AUSE", "KURO", "CHIN", "TASM", "NEWZ", "SPSG", "ARCH",
)

FAMILY_TIP_NAMES = {
    "Belonidae": "Scomberesocidae",
    "mrcaott801ott480916": "Ariidae",
    "mrcaott595ott3629079": "Sternoptychidae",
    "Gonostomatidae_(family_in_Opisthokonta)": "Gonostomatidae",
    "mrcaott47507ott47509": "Acanthuridae",
    "mrcaott7529ott77068": "Cottidae",
    "mrcaott9658ott106653": "Pholidae",
    "mrcaott15200ott303035": "Nototheniidae",
    "mrcaott126948ott301378": "Cheilodactylidae",
    "mrcaott7815ott9211": "Gobiidae",
    "mrcaott61966ott80330": "Bythitidae",
    "mrcaott56885ott4134216": "Lotidae",
    "mrcaott13841ott182974": "Nettastomatidae",
    "mrcaott65747ott167810": "Ophichthidae",
    "mrcaott73302ott93287": "Atherinopsidae",
    "Alepocephaliformes": "Alepocephalidae",
    "Ephippiformes": "Ephippidae",
}

ORDER_TIP_NAMES = {
    "mrcaott17080ott19944": "Carcharhiniformes",
    "Pristiformes/Rhiniformes_group": "Squaliformes",
    "Carangaria": "Perciformes",
    "Gasterosteales": "Trachiniformes",
    "mrcaott13841ott64982": "Anguilliformes",
}

# ------------------------------------------------------------------------------------


def found(habitat: ColumnLike, groups: Mapping[str, Sequence[str]] = HABITAT_GROUPS) -> Column:
    """Habitat text to demersal / pelagic, else null."""
    return rsem.grouped(habitat, groups)


def gear(equipment: ColumnLike) -> Column:
    return rsem.grouped(equipment, GEAR_GROUPS)


def capture(purpose: ColumnLike) -> Column:
    return rsem.grouped(purpose, CAPTURE_GROUPS)


def repair_province(code: ColumnLike) -> Column:
    return rsem.mapped(code, PROVINCE_REPAIRS, keep_other=True)


def repair_family(family: ColumnLike) -> Column:
    return rsem.mapped(family, FAMILY_REPAIRS, keep_other=True)


def commercial_status(status: ColumnLike, wide: bool = False) -> Column:
    """Collapse commercial status; other texts stay.  ``wide`` adds subsistence fisheries."""
    groups = COMMERCIAL_GROUPS_WIDE if wide else COMMERCIAL_GROUPS
    return rsem.grouped(status, groups, keep_other=True)


def is_commercial(status: ColumnLike) -> Column:
    """1 for a commercial species, 0 otherwise and for null; use before collapsing."""
    return F.when(_c(status).isin(*COMMERCIAL_VALUES), 1).otherwise(0)


def coast_label(adjacency: ColumnLike) -> Column:
    a = _c(adjacency)
    return F.when(a == 1, "coastal").when(a == 0, "oceanic")


def adjacency_water(water_type: ColumnLike, label: ColumnLike) -> Column:
    """estuarine / coastal / oceanic; null when the deciding input is null."""
    return rsem.if_else(
        _c(water_type) == "estuarine", F.lit("estuarine"),
        rsem.if_else(_c(label) == "coastal", F.lit("coastal"), F.lit("oceanic")))


def break_point(year: ColumnLike, at: int = 2017) -> Column:
    """before / after a cut year."""
    return rsem.if_else(_c(year) >= at, F.lit("after"), F.lit("before"))


def coastal_flag(code: ColumnLike) -> Column:
    """1 when the province touches a major landmass, else 0; null stays null."""
    return F.when(_c(code).isNotNull(), _c(code).isin(*COASTAL_PROVINCES).cast("int"))


def quality_flags() -> dict[str, Column]:
    """0/1 quality flags of a record and their sum."""
    def flag(bad: Column) -> Column:
        return F.when(bad, 0).otherwise(1)

    flags = {
        "meth_3_YN": rsem.if_else(F.col("method_type") != "3", F.lit(0), F.lit(1)),
        "poly_conf_YN": flag(rsem.in_or_null("polymer_confirmation", ["none"])),
        "blanks_used_YN": flag(rsem.in_or_null("blanks_used", ["no", "not described"])),
        "clean_lab_YN": flag(
            rsem.in_or_null("clean_lab_procedures_used", ["no", "not described"])),
        "min_size_YN": flag(F.col("smallest_detection_size_limits_mm").isNull()),
    }
    flags["overall_reliability"] = (flags["poly_conf_YN"] + flags["blanks_used_YN"]
                                    + flags["clean_lab_YN"] + flags["min_size_YN"])
    return flags


def with_baseline(x: ColumnLike, baseline: str, prefix: str = "aa") -> Column:
    """Prefix one label so that it sorts first and becomes the model baseline."""
    return F.when(_c(x) == baseline, F.concat(F.lit(prefix), _c(x))).otherwise(_c(x))
