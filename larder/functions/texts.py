"""Text parsing and display labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Platform status codes, load types and their labels.
ORDER_STATUS_LABELS = {
    1: "Confirmado",
    2: "Em trânsito",
    3: "Finalizado",
    4: "Cancelado",
    5: "Em estoque",
    7: "Em Separação",
}
LOAD_TYPE_LABELS = {0: "Gelado", 1: "Seco"}
UNKNOWN_LOAD_TYPE = "Desconhecido"

DAY_FIRST = r"^(\d{1,2})-(\d{1,2})-(\d{4})\s+(\d{1,2}):(\d{1,2}):(\d{1,2})$"


def strip(text: Column) -> Column:
    """Removes leading and trailing white space of any kind."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def parse_moment(text: Column) -> Column:
    """'DD-MM-YYYY HH:MM:SS' (padding optional) as a timestamp; NULL if invalid.

    The fields are put in ISO order and cast, so no session time zone takes part.
    """
    iso = F.regexp_replace(text, DAY_FIRST, "$3-$2-$1 $4:$5:$6")
    return F.when(text.rlike(DAY_FIRST), iso.try_cast("timestamp_ntz"))


def _labels(code: Column, labels: dict[int, str], otherwise: Column) -> Column:
    named = [F.when(code == value, F.lit(label)) for value, label in labels.items()]
    return F.coalesce(*named, otherwise)


def order_status_label(code: Column) -> Column:
    return _labels(code, ORDER_STATUS_LABELS, code.cast("string"))


def load_type_label(code: Column) -> Column:
    return _labels(code, LOAD_TYPE_LABELS, F.lit(UNKNOWN_LOAD_TYPE))


# How a stored time is shown, and what stands for none.
MOMENT_SHOWN, DAY_SHOWN, NO_MOMENT = "$3/$2/$1 $4", "$3/$2/$1", "—"


def moment_label(ts: Column, shown: str = MOMENT_SHOWN) -> Column:
    """A local time as 'DD/MM/YYYY HH:MM', or as its day.

    Made from the ISO text: ``date_format`` takes an instant, and a local time that the
    session's zone skips has none.
    """
    iso = r"^(.+)-(\d\d)-(\d\d) (\d\d:\d\d).*$"
    return F.coalesce(F.regexp_replace(ts.cast("string"), iso, shown), F.lit(NO_MOMENT))
