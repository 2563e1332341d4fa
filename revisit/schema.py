"""Tables, keys, column names and the fixed values that feature names depend on."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class EventColumns:
    """Names of the three columns every history operator needs."""

    event_id: str
    entity: str
    ts: str


# Column names of the consolidated table.
MASTER = EventColumns(
    event_id="referral_referralinstanceid",
    entity="referral_clientid",
    ts="referral_referraltakendate",
)
CLIENT_KEY = "client_clientid"

TIME_PREFIX = "timefeature_"
TARGET_PREFIX = "futurereferraltargetfeature_"
LABEL = TARGET_PREFIX + "futurereferralscore"

# Child table -> (key column, item column).
CHILD_TABLES = {
    "referralissue": ("referralinstanceid", "clientissueid"),
    "referralbenefit": ("referralinstanceid", "benefittypeid"),
    "referralreason": ("referralinstanceid", "referralreasonid"),
    "referraldietaryrequirements": ("referralinstanceid", "dietaryrequirementsid"),
    "referraldomesticcircumstances": ("referralinstanceid", "domesticcircumstancesid"),
    "referraldocument": ("referralinstanceid", "referraldocumentid"),
}
CLIENT_ISSUE = ("clientid", "clientissueid")

# Client columns that are one-hot encoded.
CLIENT_CATEGORIES = (
    "clientcountryid",
    "clientaddresstypeid",
    "addresslocalityid",
    "clientresidencyid",
)

# Feature classes split into current and ever-seen columns.
SPLIT_CLASSES = (
    "referralissue_",
    "referraldomesticcircumstances_",
    "referralreason_",
    "referralbenefit_",
)

# Weeks counted by the trailing weekly counts.
WEEK_WINDOWS = (1, 4, 12)

# Columns that never become features. Matched without regard to case.
NOT_FEATURES = (
    "referral_referralinstanceid",
    "referral_clientid",
    "referral_referraltakendate",
    "referral_statusid",
    "referral_referralonhold",
    "referral_referralreadydate",
    "referral_referralcollecteddate",
    "referral_referralworkerid",
    "referral_referralpreparedworkerid",
    "referral_referralhandedworkerid",
    "referral_partnername",
    "referral_partnerid",
    "referral_dependantdetails",
    "referral_ethnicityid",
    "referral_addresslocalityid",
    "referral_addresstypeid",
    "referral_referralagencyid",
    "referral_referralagencyworkername",
    "referral_referralagencytelephonenumber",
    "referral_dietaryextranotes",
    "referral_referralnotes",
    "referral_updatetimestamp",
    "client_clientid",
    "futurereferraltargetfeature_futurereferralcount",
    "futurereferraltargetfeature_futurereferralscore",
    "futurereferraltargetfeature_futurereferralgaps",
    "timefeature_totalreferralsforclient",
    "timefeature_burstnumber",
    "timefeature_referralnumber",
    "weeks",
    "reference_date",
)


def _table(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


_long, _text, _flag = T.LongType(), T.StringType(), T.BooleanType()

# Input schemas. Dates arrive as text and are parsed by the readers.
TABLE_SCHEMAS: dict[str, T.StructType] = {
    "referral": _table(
        ("referralinstanceid", _long),
        ("clientid", _long),
        ("referraltakendate", _text),
        ("statusid", _long),
        ("referralonhold", _flag),
        ("referralreadydate", _text),
        ("referralcollecteddate", _text),
        ("referralworkerid", _long),
        ("referralpreparedworkerid", _long),
        ("referralhandedworkerid", _long),
        ("partnername", _text),
        ("partnerid", _long),
        ("dependantdetails", _text),
        ("ethnicityid", _long),
        ("addresslocalityid", _long),
        ("addresstypeid", _long),
        ("referralagencyid", _long),
        ("referralagencyworkername", _text),
        ("referralagencytelephonenumber", _text),
        ("dietaryextranotes", _text),
        ("referralnotes", _text),
        ("updatetimestamp", _text),
    ),
    "client": _table(
        ("clientid", _long),
        ("clientdateofbirth", _text),
        ("addresssincedate", _text),
        ("clientismale", _flag),
        ("partnerid", _long),
        ("clientcountryid", _long),
        ("clientaddresstypeid", _long),
        ("addresslocalityid", _long),
        ("clientresidencyid", _long),
    ),
    "clientissue": _table(("clientid", _long), ("clientissueid", _long)),
    **{
        name: _table((key, _long), (item, _long))
        for name, (key, item) in CHILD_TABLES.items()
    },
}
REQUIRED_TABLES = tuple(TABLE_SCHEMAS)



def payload_schema(more: Mapping[str, Sequence[tuple[str, str]]] | None = None) -> T.StructType:
    """The nested schema of the declared columns and of ``more``: (name, type) by table."""
    fields = []
    for name, declared in TABLE_SCHEMAS.items():
        own = [T.StructField(c, T.DataType.fromDDL(kind)) for c, kind in (more or {}).get(name, ())]
        row = T.StructType([*declared.fields, *own])
        fields.append(T.StructField(name, T.ArrayType(row), True))
    return T.StructType(fields)


PAYLOAD_SCHEMA = payload_schema()
