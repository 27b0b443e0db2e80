"""Schemas of the inputs; they are never inferred, as bank ids have leading zeros."""

from pyspark.sql import types as T

S, D, TS = T.StringType(), T.DoubleType(), T.TimestampNTZType()


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


ACCOUNTS = _struct(bank_name=S, bank_id=S, account_number=S, entity_id=S, entity_name=S)

TRANSFERS = _struct(
    event_ts=TS, from_bank=S, from_account=S, to_bank=S, to_account=S, amount_received=D, receiving_currency=S,
    amount_paid=D, payment_currency=S, payment_format=S, is_laundering=T.BooleanType(),
)

FX = _struct(fx_date=T.DateType(), iso=S, rate=D)

#: Header of each query's result file (fixed values).
RESULT_HEADERS = {
    "q1": ["From Bank", "Account", "To Bank", "Account.1", "Amount Paid"],
    "q2": ["From Bank", "Account", "Bank Name", "Amount Paid"],
    "q3": ["From Bank", "Account", "Payment Format", "Amount Paid"],
    "q4": ["Bank", "Account"],
    "q5": ["Size"],
}
