"""License classes: an exact table, then ordered patterns, then `other`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Licenses of each class.
CLASSES = {
    "permissive": "apache-2.0 mit bsd bsd-2-clause bsd-3-clause bsd-3-clause-clear afl-3.0 artistic-2.0 bsl-1.0 cc-by-2.0 cc-by-2.5 cc-by-3.0 cc-by-4.0 cc0-1.0 pddl unlicense wtfpl zlib isc ncsa postgresql ecl-2.0 ms-pl etalab-2.0 odc-by cdla-permissive-1.0 cdla-permissive-2.0 openmdw-1.0 openmdw-1.1 apple-ascl",
    "copyleft": "gpl gpl-2.0 gpl-3.0 agpl-3.0 lgpl lgpl-2.1 lgpl-3.0 lgpl-lr mpl-2.0 epl-1.0 epl-2.0 eupl-1.1 eupl-1.2 osl-3.0 cc-by-sa-3.0 cc-by-sa-4.0 cdla-sharing-1.0 odbl gfdl ofl-1.1",
    "responsible_ai": "openrail openrail++ creativeml-openrail-m bigscience-bloom-rail-1.0 bigscience-openrail-m bigcode-openrail-m",
    "vendor_custom": "llama2 llama3 llama3.1 llama3.2 llama3.3 llama4 gemma grok2-community",
    "noncommercial": "cc-by-nc-2.0 cc-by-nc-3.0 cc-by-nc-4.0 cc-by-nc-sa-2.0 cc-by-nc-sa-3.0 cc-by-nc-sa-4.0 cc-by-nc-nd-3.0 cc-by-nc-nd-4.0 fair-noncommercial-research-license intel-research h-research apple-amlr deepfloyd-if-license",
    "no_derivatives": "cc-by-nd-4.0",
    "other": "c-uda lppl-1.3c cc other",
    "unknown": "unknown",
}
RULES = [
    ("noncommercial", r"(^|-)nc(-|$)|non-?commercial|research|academic"),
    ("no_derivatives", r"(^|-)nd(-|$)"),
    ("copyleft", r"^(a|l)?gpl|^cc-by-sa|^mpl|^epl|^eupl|^osl"),
    ("responsible_ai", r"openrail|^bigscience|^creativeml"),
    ("vendor_custom", r"llama|gemma|qwen|deepseek|mistral|falcon"),
    ("permissive", r"^apache|^mit$|^bsd|^cc-by-\d|^cc0|^unlicense|^afl|^zlib|^isc|^wtfpl|^artistic|^bsl-1"),
]
COMMERCIAL = ["permissive", "copyleft", "responsible_ai", "vendor_custom"]


def license_class(license_: Column, table: dict[str, str] = CLASSES) -> Column:
    low = F.lower(license_)
    out = F.when(F.coalesce(license_, F.lit("")) == "", "unknown").when(low.startswith("override:"), F.get(F.split(low, ":", 2), F.lit(1)))
    for name, members in table.items():
        out = out.when(low.isin(members.split()), name)
    for name, pattern in RULES:
        out = out.when(low.rlike(pattern), name)
    return out.otherwise("other")


def commercial(class_: Column, strict: bool = False) -> Column:
    return class_.isin(["permissive"] if strict else COMMERCIAL)
