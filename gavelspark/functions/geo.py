"""Coordinates of places by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import fold_accents

#: City, state, latitude, longitude, in the order in which names are compared. Fixed values.
PLACES = [
    ("sao paulo", "sp", -23.5505, -46.6333), ("campinas", "sp", -22.9099, -47.0626), ("santos", "sp", -23.9608, -46.3336), ("ribeirao preto", "sp", -21.1775, -47.8103),
    ("sorocaba", "sp", -23.5015, -47.4526), ("sao jose dos campos", "sp", -23.1896, -45.8841), ("osasco", "sp", -23.5324, -46.7917), ("guarulhos", "sp", -23.4543, -46.5337),
    ("rio de janeiro", "rj", -22.9068, -43.1729), ("niteroi", "rj", -22.8838, -43.1034), ("petropolis", "rj", -22.5112, -43.1779), ("nova iguacu", "rj", -22.7556, -43.4603),
    ("belo horizonte", "mg", -19.9167, -43.9345), ("uberlandia", "mg", -18.9186, -48.2772), ("contagem", "mg", -19.9318, -44.0539), ("juiz de fora", "mg", -21.7642, -43.3496),
    ("curitiba", "pr", -25.4284, -49.2733), ("londrina", "pr", -23.3045, -51.1696), ("maringa", "pr", -23.4205, -51.9333), ("ponta grossa", "pr", -25.0916, -50.1668),
    ("cascavel", "pr", -24.9578, -53.4595), ("porto alegre", "rs", -30.0346, -51.2177), ("caxias do sul", "rs", -29.1634, -51.1797), ("pelotas", "rs", -31.7654, -52.3376),
    ("canoas", "rs", -29.9178, -51.1839), ("florianopolis", "sc", -27.5954, -48.548), ("joinville", "sc", -26.3045, -48.8487), ("blumenau", "sc", -26.9194, -49.0661),
    ("chapeco", "sc", -27.1006, -52.6152), ("salvador", "ba", -12.9714, -38.5014), ("feira de santana", "ba", -12.2664, -38.9663), ("vitoria da conquista", "ba", -14.8615, -40.8442),
    ("recife", "pe", -8.0476, -34.877), ("olinda", "pe", -8.0089, -34.8553), ("jaboatao dos guararapes", "pe", -8.1128, -35.0158), ("fortaleza", "ce", -3.7172, -38.5433),
    ("caucaia", "ce", -3.7361, -38.6531), ("juazeiro do norte", "ce", -7.2131, -39.3151), ("goiania", "go", -16.6869, -49.2648), ("aparecida de goiania", "go", -16.8198, -49.2469),
    ("anapolis", "go", -16.3281, -48.9534), ("brasilia", "df", -15.7975, -47.8919), ("manaus", "am", -3.119, -60.0217), ("belem", "pa", -1.4558, -48.4902),
    ("sao luis", "ma", -2.5307, -44.3068), ("teresina", "pi", -5.0892, -42.8019), ("natal", "rn", -5.7945, -35.211), ("joao pessoa", "pb", -7.1195, -34.845),
    ("maceio", "al", -9.6498, -35.7089), ("aracaju", "se", -10.9472, -37.0731), ("vitoria", "es", -20.3155, -40.3128), ("vila velha", "es", -20.3297, -40.2925),
    ("cuiaba", "mt", -15.6014, -56.0979), ("campo grande", "ms", -20.4697, -54.6201), ("porto velho", "ro", -8.7612, -63.9004), ("rio branco", "ac", -9.9754, -67.8249),
    ("palmas", "to", -10.2491, -48.3243), ("boa vista", "rr", 2.8235, -60.6758), ("macapa", "ap", 0.0349, -51.0694),
]
#: The capital of each state. Fixed values.
CAPITALS = {
    "sp": "sao paulo", "rj": "rio de janeiro", "mg": "belo horizonte", "pr": "curitiba", "rs": "porto alegre", "sc": "florianopolis",
    "ba": "salvador", "pe": "recife", "ce": "fortaleza", "go": "goiania", "df": "brasilia", "am": "manaus",
    "pa": "belem", "ma": "sao luis", "pi": "teresina", "rn": "natal", "pb": "joao pessoa", "al": "maceio",
    "se": "aracaju", "es": "vitoria", "mt": "cuiaba", "ms": "campo grande", "ro": "porto velho", "ac": "rio branco",
    "to": "palmas", "rr": "boa vista", "ap": "macapa",
}


def places_table(spark: SparkSession) -> DataFrame:
    """A row for each place, in order."""
    rows = [(i, *place, CAPITALS[place[1]] == place[0]) for i, place in enumerate(PLACES)]
    return spark.createDataFrame(rows, "place_order int, place_city string, place_state string, lat double, lon double, is_capital boolean")


def place_key(city: Column) -> Column:
    """A city's name as it is compared."""
    return F.trim(fold_accents(F.lower(city)))
