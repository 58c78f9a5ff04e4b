"""Normalise timestamps of mixed notation and zone to one unambiguous form.

A value is reduced to its shape mask: every digit becomes ``9``, the name of a
month ``M``, of a day of the week ``D``, a name that can be either ``X``; the
short words that notations are made of stay, any other word becomes ``W``. A
mask so holds all that decides between notations, and each distinct mask is
mapped to its one parser once; all values with that mask are then converted
together with numpy. Local times go through a table of the zone's transitions,
built once per worker from the installed time-zone database. The version of
that database (:func:`zone_table_version`) is taken when the plan is made: a
worker with another one fails instead of giving other instants, and the result
can carry it in a column.

Defined results: null, blank, relative or wordy values, impossible dates, and
local times that occur twice or never in their zone give null. A value without
a time of day gives ``yyyy-MM-dd`` as written; any other one gives
``yyyy-MM-ddTHH:mm:ssZ`` in UTC, fractions dropped. A missing zone or an
unknown one gives null for local times. Texts of any length are read in whole;
digits are those of ASCII.
"""

from __future__ import annotations

import datetime as dt
import functools
import re
import unicodedata
import zoneinfo

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of the months, by language.
MONTHS = {
    "es": ["enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"],
    "en": ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"],
    "pt": ["janeiro", "fevereiro", "marco", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro"],
}
# Names of the days of the week.
DAYS = [
    "lunes", "martes", "miercoles", "jueves", "viernes", "sabado", "domingo",
    "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday",
    "segunda", "terca", "quarta", "quinta", "sexta",
]
# Zone abbreviations with one meaning in news feeds, in minutes from UTC.
ZONE_MINUTES = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "eet": 120, "eest": 180,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420,
    "art": -180, "brt": -180, "clt": -240, "clst": -180, "cot": -300, "pet": -300, "uyt": -180, "vet": -240, "bot": -240,
}

_MONTH_NUMBER: dict[str, int] = {"set": 9, "sept": 9, "setiembre": 9}
for _names in MONTHS.values():
    for _i, _name in enumerate(_names, 1):
        _MONTH_NUMBER.setdefault(_name, _i)
        _MONTH_NUMBER.setdefault(_name[:3], _i)
_DAY_NAMES = set(DAYS) | {d[:3] for d in DAYS}

_TIME = r"(?P<H>[0-9]{1,2}):(?P<M>[0-9]{2})(?::(?P<S>[0-9]{2})(?:[.,][0-9]{1,9})?)?"
_AMPM = r"(?:\s?(?P<ap>[ap])\.?\s?m(?![^\W\d_])\.?)?"
_ZONE = r"(?:\s?(?P<z>[+-][0-9]{2}(?::?[0-9]{2})?|[a-z]+(?:[/_+-][a-z0-9]+)*))?"
_DAY = r"(?:(?P<wd>[^\W\d_]+)\.?,?\s)?"
_HOURS = r"(?:\s?(?:h|hs|hrs|horas)\.?)?"

#: Notations, most specific first: (name, pattern). Groups: y m d (or a b in the source's order), H M S, ap, z, mon, wd, n.
NOTATIONS: list[tuple[str, re.Pattern]] = [
    (name, re.compile(pattern))
    for name, pattern in [
        ("epoch", r"(?P<n>[0-9]{10}|[0-9]{13}|[0-9]{16})"),
        ("compact_day", r"(?P<y>[0-9]{4})(?P<m>[0-9]{2})(?P<d>[0-9]{2})"),
        ("compact", rf"(?P<y>[0-9]{{4}})(?P<m>[0-9]{{2}})(?P<d>[0-9]{{2}})[t ]?(?P<H>[0-9]{{2}})(?P<M>[0-9]{{2}})(?P<S>[0-9]{{2}})?(?:[.,][0-9]{{1,9}})?{_ZONE}"),
        ("iso_day", r"(?P<y>[0-9]{4})([-/.])(?P<m>[0-9]{1,2})\2(?P<d>[0-9]{1,2})"),
        ("iso", rf"(?P<y>[0-9]{{4}})([-/.])(?P<m>[0-9]{{1,2}})\2(?P<d>[0-9]{{1,2}})(?:t|\s|,\s){_TIME}{_AMPM}{_ZONE}{_HOURS}"),
        ("mail", rf"{_DAY}(?P<d>[0-9]{{1,2}})\s(?P<mon>[^\W\d_]+)\.?,?\s(?P<y>[0-9]{{4}}),?\s{_TIME}{_AMPM}{_ZONE}{_HOURS}"),
        ("mail_day", rf"{_DAY}(?P<d>[0-9]{{1,2}})[\s-](?P<mon>[^\W\d_]+)\.?,?[\s-](?P<y>[0-9]{{4}})"),
        ("long", rf"{_DAY}(?P<d>[0-9]{{1,2}})(?:º|o)?\sde\s(?P<mon>[^\W\d_]+)\sdel?\s(?P<y>[0-9]{{4}})(?:,|\s-|\sa\slas|,\sa\slas)?\s{_TIME}{_AMPM}{_HOURS}{_ZONE}"),
        ("long_day", rf"{_DAY}(?P<d>[0-9]{{1,2}})(?:º|o)?\sde\s(?P<mon>[^\W\d_]+)\sdel?\s(?P<y>[0-9]{{4}})"),
        ("english", rf"{_DAY}(?P<mon>[^\W\d_]+)\.?\s(?P<d>[0-9]{{1,2}}),?\s(?P<y>[0-9]{{4}}),?\s{_TIME}{_AMPM}{_ZONE}"),
        ("english_day", rf"{_DAY}(?P<mon>[^\W\d_]+)\.?\s(?P<d>[0-9]{{1,2}}),?\s(?P<y>[0-9]{{4}})"),
        ("digits", rf"(?P<a>[0-9]{{1,2}})([-/.])(?P<b>[0-9]{{1,2}})\2(?P<y>[0-9]{{4}}|[0-9]{{2}})(?:,?\s|,?\s?-\s?){_TIME}{_AMPM}{_HOURS}{_ZONE}"),
        ("digits_day", r"(?P<a>[0-9]{1,2})([-/.])(?P<b>[0-9]{1,2})\2(?P<y>[0-9]{4}|[0-9]{2})"),
    ]
]


# The words that notations are made of.
CONNECTING = frozenset("a al as de del la las o t z h hs hrs horas p m am pm".split())
_PIECE = re.compile(r"[0-9]|[^\W\d_]+")
#: A value that stands for all of a class of the mask.
_STANDS_FOR = {"9": "1", "M": "mayo", "D": "lunes", "X": "mar", "W": "utc"}


@functools.lru_cache(maxsize=50_000)
def _class_of(piece: str) -> str:
    if piece[0].isdigit():
        return "9"
    month, day = piece in _MONTH_NUMBER, piece in _DAY_NAMES
    return "X" if month and day else "M" if month else "D" if day else piece if piece in CONNECTING else "W"


def class_mask(folded: str) -> str:
    """Character-class mask of a folded value (lower case, no accents): classes are capitals and ``9``."""
    return _PIECE.sub(lambda found: _class_of(found[0]), folded)


@functools.lru_cache(maxsize=4096)
def parser_of(mask: str) -> tuple[str, re.Pattern] | None:
    """The one notation that values of a mask are written in, decided on a value that stands for them all."""
    digits = mask.count("9")
    stands = re.sub("[9MDXW]", lambda found: _STANDS_FOR[found[0]], mask)
    for name, pattern in NOTATIONS:
        if (name == "epoch") != (mask == "9" * digits and digits in (10, 13, 16)):
            continue
        found = pattern.fullmatch(stands)
        if found and (found.groupdict().get("wd") or "lunes") in _DAY_NAMES:
            return name, pattern
    return None


@functools.cache
def _known_zones() -> frozenset[str]:
    return frozenset(zoneinfo.available_timezones())


@functools.lru_cache(maxsize=1024)
def zone_transitions(name: str) -> tuple[np.ndarray, np.ndarray] | None:
    """(UTC seconds at which an offset begins, the offset), or null for an unknown zone; covers 1900 to 2100."""
    if name not in _known_zones():
        return None
    zone = zoneinfo.ZoneInfo(name)
    utc = dt.UTC

    def offset(t: int) -> int:
        return int((dt.datetime(1970, 1, 1, tzinfo=utc) + dt.timedelta(seconds=t)).astimezone(zone).utcoffset().total_seconds())

    start, end, step = -2208988800, 4102444800, 14 * 86400
    at, offsets = [-(2**62)], [offset(start)]
    left = start
    while left < end:
        right = left + step
        if offset(right) != offsets[-1]:
            low, high = left, right
            while high - low > 1:
                mid = (low + high) // 2
                low, high = (mid, high) if offset(mid) == offsets[-1] else (low, mid)
            at.append(high)
            offsets.append(offset(high))
            left = high
        else:
            left = right
    return np.array(at, dtype=np.int64), np.array(offsets, dtype=np.int64)


@functools.cache
def zone_table_version() -> str:
    """Version of the time-zone database behind :func:`zone_transitions`."""
    for folder in zoneinfo.TZPATH:
        try:
            with open(f"{folder}/tzdata.zi", encoding="utf-8") as lines:
                return lines.readline().rpartition(" ")[2].strip()
        except OSError:
            continue
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        return "unknown"


def local_to_utc(local: np.ndarray, zone: str) -> tuple[np.ndarray, np.ndarray]:
    """UTC seconds of local seconds in ``zone``; the mask is false where they occur twice or never, or the zone is unknown."""
    table = zone_transitions(zone)
    if table is None:
        return local, np.zeros(len(local), dtype=bool)
    at, offsets = table
    before = offsets[np.searchsorted(at, local - 86400, side="right") - 1]
    after = offsets[np.searchsorted(at, local + 86400, side="right") - 1]
    first, second = local - before, local - after
    fits_first = offsets[np.searchsorted(at, first, side="right") - 1] == before
    fits_second = offsets[np.searchsorted(at, second, side="right") - 1] == after
    same = before == after
    return np.where(fits_first, first, second), np.where(same, fits_first, fits_first ^ fits_second)


def _days_from_civil(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    months = (y.astype(np.int64) - 1970) * 12 + m - 1
    first = months.astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
    return first + d - 1


def _valid_day(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    inside = (m >= 1) & (m <= 12) & (d >= 1) & (y >= 1000) & (y <= 9999)
    mm, yy = np.where(inside, m, 1), np.where(inside, y, 2000)
    last = _days_from_civil(yy + mm // 12, mm % 12 + 1, np.ones_like(mm)) - _days_from_civil(yy, mm, np.ones_like(mm))
    return inside & (d <= last)


def _folded(values: pd.Series) -> pd.Series:
    """Lower case, single spaces, letters without accents (``º`` stays)."""
    plain = values.str.lower().str.replace(r"\s+", " ", regex=True).str.strip()
    rare = ~plain.map(str.isascii)
    if rare.any():
        plain = plain.copy()
        plain[rare] = plain[rare].map(lambda x: "".join(c for c in unicodedata.normalize("NFD", x) if not unicodedata.combining(c)))
    return plain


def _number(found: pd.DataFrame, name: str, absent: int = 0) -> np.ndarray:
    if name not in found:
        return np.full(len(found), absent, dtype=np.int64)
    return pd.to_numeric(found[name]).fillna(absent).to_numpy().astype(np.int64)


def _convert(name: str, found: pd.DataFrame, zones: pd.Series, orders: pd.Series, raw: pd.Series) -> pd.Series:
    """The normal form of values of one notation, null where a part is out of range."""
    n = len(found)
    if name == "epoch":
        number = pd.to_numeric(found["n"]).to_numpy(dtype=np.int64)
        scale = np.select([found["n"].str.len() == 13, found["n"].str.len() == 16], [1000, 1_000_000], 1)
        return _instants(number // scale, np.ones(n, dtype=bool), found.index)
    y = _number(found, "y")
    if "mon" in found:
        m = found["mon"].map(_MONTH_NUMBER).fillna(0).to_numpy().astype(np.int64)
        d = _number(found, "d")
    elif "a" in found:
        a, b = _number(found, "a"), _number(found, "b")
        month_first = (orders == "mda").to_numpy()
        known = orders.isin(["mda", "dma"]).to_numpy()
        m, d = np.where(month_first, a, b), np.where(month_first, b, a)
        m = np.where(known, m, 0)
        y = np.where(found["y"].str.len() == 2, y + np.where(y < 70, 2000, 1900), y)
    else:
        m, d = _number(found, "m"), _number(found, "d")
    good = _valid_day(y, m, d)
    if "wd" in found:
        named = found["wd"]
        good &= (named.isna() | named.isin(_DAY_NAMES)).to_numpy()
    if name.endswith("day"):
        text = pd.Series(y).astype(str).str.zfill(4) + "-" + pd.Series(m).astype(str).str.zfill(2) + "-" + pd.Series(d).astype(str).str.zfill(2)
        return pd.Series(np.where(good, text.to_numpy(dtype=object), None), index=found.index, dtype=object)
    hour, minute, second = _number(found, "H"), _number(found, "M"), _number(found, "S")
    if "ap" in found:
        half = found["ap"]
        twelve = half.notna().to_numpy()
        good &= ~twelve | ((hour >= 1) & (hour <= 12))
        hour = np.where(twelve, hour % 12 + np.where((half == "p").to_numpy(), 12, 0), hour)
    good &= (hour < 24) & (minute < 60) & (second < 60)
    local = np.where(good, _days_from_civil(np.where(good, y, 1970), np.where(good, m, 1), np.where(good, d, 1)), 0) * 86400 + hour * 3600 + minute * 60 + second
    own = found["z"] if "z" in found else pd.Series([None] * n, index=found.index, dtype=object)
    own = own.where(~own.isin(["h", "hs", "hrs", "horas"]), None)
    zone_key = own.where(own.notna(), None)
    seconds = local.copy()
    for key in zone_key.dropna().unique():
        at = (zone_key == key).to_numpy()
        if key[0] in "+-":
            h, mi = int(key[1:3]), int(key[3:].lstrip(":") or 0)
            good[at] &= h <= 18 and mi < 60
            seconds[at] = local[at] - (-1 if key[0] == "-" else 1) * (h * 3600 + mi * 60)
        elif key in ZONE_MINUTES:
            seconds[at] = local[at] - ZONE_MINUTES[key] * 60
        else:
            written = raw[at].str.extract(r"([^\W\d_]+(?:[/_+-][^\W_]+)+)\s*$")[0]
            for original in written.fillna("").unique():
                part = at & (written.fillna("").reindex(raw.index) == original).to_numpy()
                seconds[part], fits = local_to_utc(local[part], original)
                good[part] &= fits
    bare = zone_key.isna().to_numpy()
    for zone in zones[bare].fillna("").unique():
        at = bare & (zones.fillna("") == zone).to_numpy()
        seconds[at], fits = local_to_utc(local[at], zone) if zone else (local[at], np.zeros(at.sum(), dtype=bool))
        good[at] &= fits
    return _instants(seconds, good, found.index)


def _instants(seconds: np.ndarray, good: np.ndarray, index: pd.Index) -> pd.Series:
    text = np.datetime_as_string(np.where(good, seconds, 0).astype("datetime64[s]"), unit="s")
    return pd.Series(np.where(good, np.char.add(text, "Z").astype(object), None), index=index, dtype=object)


def normalise_batch(values: pd.Series, zones: pd.Series, orders: pd.Series) -> pd.Series:
    """Normal form of each value; ``zones`` and ``orders`` are the zone and the day/month order of its source."""
    out = pd.Series([None] * len(values), index=values.index, dtype=object)
    present = values.notna()
    if not present.any():
        return out
    plain = _folded(values[present])
    masks = plain.map({x: class_mask(x) for x in plain.unique()})
    for mask, index in masks.groupby(masks).groups.items():
        # The cache holds short masks only; a long one is as well mapped once a batch.
        parser = parser_of(mask) if len(mask) <= 200 else parser_of.__wrapped__(mask)
        if parser is None:
            continue
        name, pattern = parser
        found = plain.loc[index].str.extract(rf"^(?:{pattern.pattern})$")
        found = found.loc[found["n" if name == "epoch" else "y"].notna(), [c for c in found.columns if isinstance(c, str)]]
        if len(found):
            out.loc[found.index] = _convert(name, found, zones.loc[found.index], orders.loc[found.index], values.loc[found.index])
    return out


def normalise_timestamps(df: DataFrame, text: str, zone: str, order: str, out: str = "normal", version: str | None = None) -> DataFrame:
    """Add ``out``, the normal form of column ``text``, given columns with the source's zone and day/month order.

    ``version`` names a column for the version of the zone tables behind the result.
    """
    tables = zone_table_version()

    @F.pandas_udf("string")
    def normal(values: pd.Series, zones: pd.Series, orders: pd.Series) -> pd.Series:
        if zone_table_version() != tables:
            raise RuntimeError(f"zone tables {zone_table_version()} on a worker, {tables} on the driver")
        return normalise_batch(values, zones, orders)

    found = df.withColumn(out, normal(F.col(text), F.col(zone), F.col(order)))
    return found.withColumn(version, F.lit(tables)) if version else found


def shape_of(text: Column) -> Column:
    """The plain shape of a text (digits ``9``, runs of letters ``a``) as a JVM expression, for profiling a column's notations."""
    return F.regexp_replace(F.regexp_replace(text, r"\p{L}+", "a"), r"\p{Nd}", "9")
