"""References of project files. XPath of the engine stops a job at the first malformed document, so a parser reads them in batches."""

from __future__ import annotations

from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

_SCHEMA = StructType([StructField("valid", BooleanType()), StructField("sdk", StringType()), StructField("packages", ArrayType(StringType()))])


def references(text: str | None) -> tuple[bool, str, list[str]]:
    """Whether ``text`` is well-formed, its root's Sdk, and the PackageReference names in it, at any depth, in order.

    A name is Include, or Update where that is missing; blank ones are left out, and so are elements with a namespace."""
    try:
        root = ElementTree.fromstring((text or "").removeprefix("﻿"))
    except ElementTree.ParseError:
        return False, "", []
    names = [x.get("Include", x.get("Update")) for x in root.iter("PackageReference") if x is not root]
    return True, root.get("Sdk", ""), [n for n in names if n and n.strip()]


@F.pandas_udf(_SCHEMA)
def xml_references(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([references(t) for t in texts], columns=["valid", "sdk", "packages"])
