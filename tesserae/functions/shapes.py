"""Shapes of model responses: schemas, exact keys, types as JSON has them, domains.

An answer is parsed into a variant, which keeps the types that the text has: a number, list, object or boolean where text
is due is told from text, at every depth, and nothing is cast. Text that is no JSON, or that names a key twice, has no shape.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.functions.text import SPACE_CLASS

# The domains of the closed lists.
QUOTE_TYPES = ("desire", "irritation", "repeat_trigger", "objection", "combinability", "language")
FACT_TYPES = ("offer", "pricing", "policy", "sizing", "shipping_returns", "social_proof", "positioning")
CONFIDENCES = ("high", "medium", "low")
VERDICTS = ("supported", "unsupported", "ambiguous")
EVIDENCE_KINDS = ("voc", "finding")


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


_S = T.StringType()
# The fields of model responses.
QUOTE = struct(quote=_S, type=_S, theme=_S, product_area=_S, confidence=_S)
FINDING = struct(fact_type=_S, statement=_S, detail=_S, evidence=_S, confidence=_S)
EXTRACTION = struct(quotes=T.ArrayType(QUOTE), findings=T.ArrayType(FINDING))
LABEL = struct(verdict=_S, rationale=_S)
SYNTHESIS = struct(title=_S, pains=T.ArrayType(struct(theme=_S, summary=_S, evidence_refs=T.ArrayType(struct(kind=_S, id=_S)))))
WHITESPACE = struct(candidates=T.ArrayType(struct(angle_key=_S, summary=_S)))


USAGE = struct(input_tokens=T.LongType(), output_tokens=T.LongType())
_TYPE_NAMES = {T.StringType: "STRING", T.LongType: "BIGINT", T.BooleanType: "BOOLEAN"}


def parsed(json: Column) -> Column:
    """The JSON text as a variant; null where it is none."""
    return F.try_parse_json(json)


def items(value: Column, field: str) -> Column:
    """The items of a list field, each a variant; null where there is no such list."""
    return F.try_variant_get(value, f"$.{field}", "array<variant>")


def fits(value: Column, shape: T.DataType) -> Column:
    """Whether a variant has this type throughout: objects have exactly the fields of theirs, items of lists fit each."""
    if isinstance(shape, T.StructType):
        fields = F.try_variant_get(value, "$", "map<string,variant>")
        ok = F.array_sort(F.map_keys(fields)) == F.array(*[F.lit(n) for n in sorted(shape.names)])
        for f in shape.fields:
            ok = ok & fits(fields[f.name], f.dataType)
        return F.coalesce(ok, F.lit(False))
    if isinstance(shape, T.ArrayType):
        return F.coalesce(F.forall(F.try_variant_get(value, "$", "array<variant>"), lambda x: fits(x, shape.elementType)), F.lit(False))
    return F.coalesce(F.schema_of_variant(value) == _TYPE_NAMES[type(shape)], F.lit(False))


def read(value: Column, shape: T.StructType) -> Column:
    """A variant that fits a shape as a struct."""
    return F.try_variant_get(value, "$", shape.simpleString())


def json_schema(shape: T.StructType, domains: dict[str, tuple[str, ...]] | None = None) -> dict:
    """The JSON schema of a response: all keys required, no others, closed lists where a domain is given by field name."""
    def one(name: str, t: T.DataType) -> dict:
        if isinstance(t, T.StructType):
            return json_schema(t, domains)
        if isinstance(t, T.ArrayType):
            return {"type": "array", "items": one(name, t.elementType)}
        own = {"type": {T.LongType: "integer", T.BooleanType: "boolean"}.get(type(t), "string")}
        return own | {"enum": list(domains[name])} if domains and name in domains else own

    return {"type": "object", "properties": {f.name: one(f.name, f.dataType) for f in shape.fields}, "required": shape.names, "additionalProperties": False}


def is_filled(s: Column) -> Column:
    """Whether there is anything but white space."""
    return F.coalesce(F.regexp_replace(s, SPACE_CLASS + "+", "") != "", F.lit(False))


def is_label(json: Column) -> Column:
    """A well-formed label: both keys, a verdict of the list, a rationale that is text and not blank."""
    label = read(parsed(json), LABEL)
    return fits(parsed(json), LABEL) & F.coalesce(label["verdict"].isin(*VERDICTS), F.lit(False)) & is_filled(label["rationale"])


def is_usage(json: Column, most_in: int, most_out: int) -> Column:
    """Whether a response states its tokens: whole numbers, no booleans, not negative, no more than could be asked for."""
    used = read(parsed(json), USAGE)
    return fits(parsed(json), USAGE) & F.coalesce(used["input_tokens"].between(0, most_in) & used["output_tokens"].between(0, most_out), F.lit(False))


def is_quote(value: Column) -> Column:
    """A variant that is a well-formed quote: all fields text, a quote that is not blank, a known type and confidence."""
    q = read(value, QUOTE)
    return fits(value, QUOTE) & is_filled(q["quote"]) & F.coalesce(q["type"].isin(*QUOTE_TYPES) & q["confidence"].isin(*CONFIDENCES), F.lit(False))


def is_finding(value: Column) -> Column:
    """A variant that is a well-formed finding: all fields text, statement and evidence not blank, a known type and confidence."""
    f = read(value, FINDING)
    return fits(value, FINDING) & is_filled(f["statement"]) & is_filled(f["evidence"]) & F.coalesce(f["fact_type"].isin(*FACT_TYPES) & f["confidence"].isin(*CONFIDENCES), F.lit(False))


def is_synthesis(json: Column) -> Column:
    """A well-formed synthesis: exact keys throughout, a title, pains with theme and summary, references of a known kind with an id."""
    r = read(parsed(json), SYNTHESIS)
    ref = lambda x: F.coalesce(x["kind"].isin(*EVIDENCE_KINDS), F.lit(False)) & is_filled(x["id"])
    pains = F.forall(r["pains"], lambda p: is_filled(p["theme"]) & is_filled(p["summary"]) & F.coalesce(F.forall(p["evidence_refs"], ref), F.lit(False)))
    return fits(parsed(json), SYNTHESIS) & is_filled(r["title"]) & F.coalesce(pains, F.lit(False))


def is_whitespace(json: Column) -> Column:
    """A well-formed whitespace answer: exact keys, candidates with an angle key and a summary."""
    r = read(parsed(json), WHITESPACE)
    return fits(parsed(json), WHITESPACE) & F.coalesce(F.forall(r["candidates"], lambda c: is_filled(c["angle_key"]) & is_filled(c["summary"])), F.lit(False))
