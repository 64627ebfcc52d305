"""Expression rules: a reader's boolean text as a column that can neither raise nor change the rows.

Spark parses the text; the tree is rebuilt node by node from an allow-list of operators and functions. Every operand
is brought to the type its operator takes by a cast that gives null instead of an error, and operators that could raise
are built in their ``try_`` form or guarded (a division by zero, an index of zero, an overflow give null). What is not on the list, has a
pattern that is not constant, or names an unknown field is refused, with the reason. A null result is no match, so one
rule can stop neither the others nor the job, whatever the session's settings are.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.functions.stemming import any_stem

LEAST_LONG = -(1 << 63)


class Refused(Exception):
    """Why a text can't be a rule."""


@dataclass(frozen=True)
class Value:
    """A part of a rule. ``probe`` is the same with nulls for lambda variables, so that it has a type by itself."""

    column: Column
    probe: Column
    type: T.DataType
    #: The value of a literal, as text.
    text: str | None = None
    #: The values of an array of string literals.
    texts: tuple[str, ...] = ()
    #: For a field of stems, the field of the words themselves.
    exact: Column | None = None


def _is_number(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def _is_time(t: T.DataType) -> bool:
    return isinstance(t, T.DateType | T.TimestampType | T.TimestampNTZType)


class Compiler:
    """Compiles rule texts over the columns of ``fields``. Nothing of ``fields`` is read."""

    def __init__(self, fields: DataFrame):
        self.spark: SparkSession = fields.sparkSession
        self.empty = self.spark.createDataFrame([], fields.schema)
        self.names = {f.name.lower(): f for f in fields.schema.fields}
        self.parser = self.spark._jsparkSession.sessionState().sqlParser()

    def compile(self, text: str) -> Column:
        """The condition, never null; raises :class:`Refused`."""
        try:
            condition = F.coalesce(self._boolean(self._build(self.parser.parseExpression(text), {})).column, F.lit(False))
            # Constant parts are computed here.
            self.empty.select(condition)._jdf.queryExecution().optimizedPlan()
        except PySparkException as error:
            raise Refused(str(error).split("\n")[0]) from None
        except RecursionError:
            raise Refused("too deep") from None
        return condition

    # -------------------------------------------------------------- values

    def _typed(self, column: Column, probe: Column, text: str | None = None) -> Value:
        return Value(column, probe, self.empty.select(probe).schema[0].dataType, text)

    def _apply(self, make: Callable[..., Column], *args: Value) -> Value:
        return self._typed(make(*[a.column for a in args]), make(*[a.probe for a in args]))

    def _tried(self, value: Value, kind: str) -> Value:
        """The value as another type, null where that fails."""
        return self._apply(lambda c: c.try_cast(kind), value)

    def _string(self, value: Value) -> Value:
        if isinstance(value.type, T.StringType):
            return value
        if isinstance(value.type, T.ArrayType | T.MapType | T.StructType | T.BinaryType | T.VariantType):
            raise Refused(f"a string is wanted, not {value.type.simpleString()}")
        return self._apply(lambda c: c.cast("string"), value)

    def _number(self, value: Value) -> Value:
        """A long or a double."""
        if isinstance(value.type, T.LongType | T.DoubleType):
            return value
        if isinstance(value.type, T.IntegralType):
            return self._apply(lambda c: c.cast("long"), value)
        if _is_number(value.type):
            return self._apply(lambda c: c.cast("double"), value)
        if isinstance(value.type, T.StringType | T.NullType):
            return self._tried(value, "double")
        raise Refused(f"a number is wanted, not {value.type.simpleString()}")

    def _whole(self, value: Value, kind: str = "long") -> Value:
        if not (_is_number(value.type) or isinstance(value.type, T.StringType | T.NullType)):
            raise Refused(f"a number is wanted, not {value.type.simpleString()}")
        return self._tried(value, kind)

    def _boolean(self, value: Value) -> Value:
        if isinstance(value.type, T.BooleanType):
            return value
        if isinstance(value.type, T.StringType | T.NullType):
            return self._tried(value, "boolean")
        raise Refused(f"a condition is wanted, not {value.type.simpleString()}")

    def _time(self, value: Value) -> Value:
        if _is_time(value.type):
            return self._apply(lambda c: c.cast("timestamp"), value)
        if isinstance(value.type, T.StringType | T.NullType):
            return self._tried(value, "timestamp")
        raise Refused(f"a time is wanted, not {value.type.simpleString()}")

    def _array(self, value: Value) -> Value:
        if not isinstance(value.type, T.ArrayType):
            raise Refused(f"an array is wanted, not {value.type.simpleString()}")
        return value

    def _strings(self, value: Value) -> Value:
        if not (isinstance(value.type, T.ArrayType) and isinstance(value.type.elementType, T.StringType | T.NullType)):
            raise Refused(f"an array of strings is wanted, not {value.type.simpleString()}")
        return self._apply(lambda c: c.cast("array<string>"), value)

    def _alike(self, values: list[Value]) -> list[Value]:
        """Values brought to one type, so that they can be compared or stand for each other."""
        kinds = [v.type for v in values if not isinstance(v.type, T.NullType)]
        if any(_is_number(t) for t in kinds):
            numbers = [self._number(v) for v in values]
            if any(isinstance(v.type, T.DoubleType) for v in numbers):
                return [self._apply(lambda c: c.cast("double"), v) for v in numbers]
            return numbers
        if any(_is_time(t) for t in kinds):
            return [self._time(v) for v in values]
        if any(isinstance(t, T.BooleanType) for t in kinds):
            return [self._boolean(v) for v in values]
        if any(isinstance(t, T.ArrayType) for t in kinds):
            if len({t.simpleString() for t in kinds}) > 1:
                raise Refused("different kinds of values")
            kind = next(t for t in kinds if isinstance(t, T.ArrayType))
            return [v if isinstance(v.type, T.ArrayType) else self._apply(lambda c: c.cast(kind), v) for v in values]
        return [self._string(v) for v in values]

    def _pattern(self, value: Value) -> Value:
        """A constant regular expression that compiles and can't exhaust the stack on a long text."""
        if value.text is None:
            raise Refused("a pattern has to be constant")
        self._groups(value.text)
        bare = re.sub(r"\\.|\[\^?\]?[^\]]*\]", "x", value.text, flags=re.S)
        if re.search(r"\)(?:[*+]|\{\d+,\}|\{\d{3,})", bare):
            raise Refused("a pattern may not repeat a group without bound")
        return value

    def _groups(self, pattern: str) -> int:
        """How many groups a pattern has."""
        try:
            return self.spark._jvm.java.util.regex.Pattern.compile(pattern).matcher("").groupCount()
        except Exception:  # noqa: BLE001 - what the gateway raises for a pattern that doesn't compile
            raise Refused("a pattern does not compile") from None

    # --------------------------------------------------------------- nodes

    def _build(self, node, variables: dict[str, Value]) -> Value:
        kind = node.getClass().getSimpleName()
        if kind == "Literal":
            literal = F.expr(node.sql())
            return self._typed(literal, literal, None if node.value() is None else str(node.value()))
        if kind == "UnresolvedAttribute":
            return self._field(_sequence(node.nameParts()))
        if kind == "UnresolvedNamedLambdaVariable":
            return self._variable(_sequence(node.nameParts()), variables)
        if kind == "Cast":
            target = node.dataType().sql()
            value = self._build(node.child(), variables)
            return self._tried(value, target)
        if kind == "UnresolvedFunction":
            if node.isDistinct() or node.filter().isDefined() or node.ignoreNulls():
                raise Refused("aggregates can't be used")
            return self._function(".".join(_sequence(node.nameParts())).lower(), list(_nodes(node.arguments())), variables)
        if kind in ("Like", "ILike") and str(node.escapeChar()) != "\\":
            raise Refused("only the usual escape character")
        if kind not in OPERATORS:
            raise Refused(f"{kind} can't be used")
        return OPERATORS[kind](self, [self._build(child, variables) for child in _nodes(node.children())])

    def _field(self, parts: list[str]) -> Value:
        field = self.names.get(parts[0].lower()) if len(parts) == 1 else None
        if field is None:
            raise Refused(f"unknown field {'.'.join(parts)}")
        column = F.col("`" + field.name.replace("`", "``") + "`")
        exact = f"{field.name}_exact"
        stems = field.name.endswith("_words") and exact in self.names
        return Value(column, column, field.dataType, exact=F.col(exact) if stems else None)

    def _variable(self, parts: list[str], variables: dict[str, Value]) -> Value:
        if len(parts) == 1 and parts[0].lower() in variables:
            return variables[parts[0].lower()]
        return self._field(parts)

    def _function(self, name: str, nodes: list, variables: dict[str, Value]) -> Value:
        if name in LAMBDAS:
            return self._lambda(name, nodes, variables)
        if name not in FUNCTIONS:
            raise Refused(f"function {name} can't be used")
        least, most, make = FUNCTIONS[name]
        if not least <= len(nodes) <= most:
            raise Refused(f"{name} with {len(nodes)} arguments")
        return make(self, [self._build(n, variables) for n in nodes])

    def _lambda(self, name: str, nodes: list, variables: dict[str, Value]) -> Value:
        if len(nodes) != 2 or nodes[1].getClass().getSimpleName() != "LambdaFunction" or nodes[1].arguments().size() != 1:
            raise Refused(f"{name} takes an array and a function of one variable")
        array = self._array(self._build(nodes[0], variables))
        (variable,) = _sequence(nodes[1].arguments().apply(0).nameParts())
        nothing = F.lit(None).cast(array.type.elementType)

        def body(element: Column) -> Value:
            own = {**variables, variable.lower(): Value(element, nothing, array.type.elementType)}
            value = self._build(nodes[1].function(), own)
            return value if name == "transform" else self._boolean(value)

        make = LAMBDAS[name]
        return self._typed(
            make(array.column, lambda element: body(element).column), make(array.probe, lambda element: body(nothing).probe)
        )


def _nodes(sequence):
    return (sequence.apply(i) for i in range(sequence.size()))


def _sequence(parts) -> list[str]:
    return [str(p) for p in _nodes(parts)]


# ------------------------------------------------------------------ operators


def _logical(make):
    return lambda c, args: c._apply(make, *[c._boolean(a) for a in args])


def _compared(make):
    return lambda c, args: c._apply(make, *c._alike(args))


def _arithmetic(try_form, plain):
    """Longs in the form that gives null on overflow; doubles don't overflow."""

    def build(c: Compiler, args: list[Value]) -> Value:
        if _is_time(args[0].type) and isinstance(args[1].type, T.DayTimeIntervalType | T.YearMonthIntervalType):
            return c._apply(try_form, c._time(args[0]), args[1])
        a, b = c._alike([c._number(x) for x in args])
        return c._apply(try_form if isinstance(a.type, T.LongType) else plain, a, b)

    return build


def _negated(c: Compiler, args: list[Value]) -> Value:
    value = c._number(args[0])
    return c._apply(lambda x: F.try_subtract(F.lit(0).cast("long"), x) if isinstance(value.type, T.LongType) else -x, value)


def _whole_division(c: Compiler, args: list[Value]) -> Value:
    def divided(a: Column, b: Column) -> Column:
        return F.call_function("div", F.nullif(a, F.lit(LEAST_LONG)), F.nullif(b, F.lit(0).cast("long")))

    return c._apply(divided, *[c._whole(a) for a in args])


def _listed(c: Compiler, args: list[Value]) -> Value:
    found = [c._apply(lambda a, b: a == b, *c._alike([args[0], other])) for other in args[1:]]
    return reduce(lambda x, y: c._apply(lambda a, b: a | b, x, y), found)


def _like(make):
    def build(c: Compiler, args: list[Value]) -> Value:
        pattern = args[1].text
        if pattern is None or not re.fullmatch(r"(?:[^\\]|\\[\\_%])*", pattern, re.S):
            raise Refused("a pattern has to be constant, with nothing but _, % and \\ escaped")
        return c._apply(lambda a: make(a, pattern), c._string(args[0]))

    return build


def _matched(c: Compiler, args: list[Value]) -> Value:
    pattern = c._pattern(args[1])
    return c._apply(F.rlike, c._string(args[0]), pattern)


def _cases(c: Compiler, args: list[Value]) -> Value:
    """Condition, value, ..., and a value otherwise."""
    pairs = len(args) // 2
    conditions = [c._boolean(args[2 * i]) for i in range(pairs)]
    values = c._alike([args[2 * i + 1] for i in range(pairs)] + args[2 * pairs :])

    def made(*columns: Column) -> Column:
        tests, results = columns[:pairs], columns[pairs:]
        out = F.when(tests[0], results[0])
        for test, result in zip(tests[1:], results[1:pairs], strict=True):
            out = out.when(test, result)
        return out.otherwise(results[pairs]) if len(results) > pairs else out

    return c._apply(made, *conditions, *values)


def _element(c: Compiler, args: list[Value]) -> Value:
    """``array[i]`` from 0; null beyond the ends."""
    return c._apply(F.get, c._array(args[0]), c._whole(args[1], "int"))


OPERATORS: dict[str, Callable[[Compiler, list[Value]], Value]] = {
    "And": _logical(lambda a, b: a & b), "Or": _logical(lambda a, b: a | b), "Not": _logical(lambda a: ~a),
    "EqualTo": _compared(lambda a, b: a == b), "EqualNullSafe": _compared(lambda a, b: a.eqNullSafe(b)),
    "LessThan": _compared(lambda a, b: a < b), "LessThanOrEqual": _compared(lambda a, b: a <= b),
    "GreaterThan": _compared(lambda a, b: a > b), "GreaterThanOrEqual": _compared(lambda a, b: a >= b),
    "Add": _arithmetic(F.try_add, lambda a, b: a + b), "Subtract": _arithmetic(F.try_subtract, lambda a, b: a - b),
    "Multiply": _arithmetic(F.try_multiply, lambda a, b: a * b), "Remainder": _arithmetic(F.try_mod, F.try_mod),
    "Divide": lambda c, args: c._apply(lambda a, b: F.try_divide(a.cast("double"), b.cast("double")), *[c._number(a) for a in args]),
    "IntegralDivide": _whole_division, "UnaryMinus": _negated, "UnaryPositive": lambda c, args: c._number(args[0]),
    "IsNull": lambda c, args: c._apply(F.isnull, *args), "IsNotNull": lambda c, args: c._apply(F.isnotnull, *args),
    "In": _listed, "Like": _like(lambda a, p: a.like(p)), "ILike": _like(lambda a, p: a.ilike(p)), "RLike": _matched,
    "CaseWhen": _cases, "UnresolvedExtractValue": _element,
    "Concat": lambda c, args: c._apply(F.concat, *[c._string(a) for a in args]),
    "Substring": lambda c, args: _substring(c, args), "StringLocate": lambda c, args: _locate(c, args),
    "StringTrim": lambda c, args: FUNCTIONS["trim"][2](c, args),
}


# ------------------------------------------------------------------ functions


def _takes(kinds: str, make: Callable[..., Column]):
    """A function whose arguments are s strings, n numbers, i and l whole numbers, t times, a arrays, w arrays of strings, x anything."""
    to = {
        "s": Compiler._string, "n": Compiler._number, "i": lambda c, v: c._whole(v, "int"), "l": Compiler._whole,
        "t": Compiler._time, "a": Compiler._array, "w": Compiler._strings, "x": lambda c, v: v,
    }
    return lambda c, args: c._apply(make, *[to[k](c, v) for k, v in zip(kinds, args, strict=False)])


def _one(kinds: str, make: Callable[..., Column], least: int | None = None):
    return (len(kinds) if least is None else least, len(kinds), _takes(kinds, make))


def _substring(c: Compiler, args: list[Value]) -> Value:
    rest = [c._whole(a, "int") for a in args[1:]]
    return c._apply(lambda s, *more: F.substr(s, *more), c._string(args[0]), *rest)


def _locate(c: Compiler, args: list[Value]) -> Value:
    start = c._whole(args[2], "int") if len(args) > 2 else c._typed(F.lit(1), F.lit(1))
    return c._apply(lambda a, b, i: F.position(a, b, i), c._string(args[0]), c._string(args[1]), start)


def _each_alike(make: Callable[..., Column]):
    return lambda c, args: c._apply(make, *c._alike(args))


def _array_of(c: Compiler, args: list[Value]) -> Value:
    if not args:
        return c._typed(*[F.array().cast("array<string>")] * 2)
    texts = all(isinstance(a.type, T.StringType) and a.text is not None for a in args)
    return replace(c._apply(F.array, *c._alike(args)), texts=tuple(a.text for a in args) if texts else ())


def _array_contains(c: Compiler, args: list[Value]) -> Value:
    array = c._array(args[0])
    element = Value(F.lit(None), F.lit(None).cast(array.type.elementType), array.type.elementType)
    _, wanted = c._alike([element, args[1]])
    return c._apply(lambda a, w: F.array_contains(a, w), array, c._apply(lambda w: w.try_cast(array.type.elementType), wanted))


def _overlap(c: Compiler, args: list[Value]) -> Value:
    a, b = c._alike([c._array(x) for x in args])
    return c._apply(F.arrays_overlap, a, b)


def _any_word(c: Compiler, args: list[Value]) -> Value:
    words, wanted = args
    if words.exact is not None and wanted.texts:
        # The stems are known, so that the other words need none.
        test = any_stem(words.exact, list(wanted.texts))
        return Value(test, test, T.BooleanType())
    return _overlap(c, [c._strings(a) for a in args])


def _any_in(c: Compiler, args: list[Value]) -> Value:
    return c._apply(lambda t, w: F.exists(w, lambda x: F.contains(t, x)), c._string(args[0]), c._strings(args[1]))


def _regexp(make: Callable[..., Column]):
    return lambda c, args: c._apply(make, c._string(args[0]), c._pattern(args[1]))


def _regexp_extract(c: Compiler, args: list[Value]) -> Value:
    text, pattern, group = c._string(args[0]), c._pattern(args[1]).text, 1
    if len(args) > 2:
        if args[2].text is None or not re.fullmatch(r"\d{1,3}", args[2].text):
            raise Refused("the number of a group has to be constant")
        group = int(args[2].text)
    if group > c._groups(pattern):
        raise Refused("no such group in the pattern")
    return c._apply(lambda t: F.regexp_extract(t, pattern, group), text)


def _regexp_replace(c: Compiler, args: list[Value]) -> Value:
    text, pattern, by = c._string(args[0]), c._pattern(args[1]).text, args[2].text
    if by is None or re.search(r"[\\$]", by):
        raise Refused("a replacement has to be constant, without groups")
    return c._apply(lambda t: F.regexp_replace(t, pattern, by), text)


def _round(c: Compiler, args: list[Value]) -> Value:
    return c._apply(lambda x: F.round(x.cast("double")), args[0] if _is_number(args[0].type) else c._number(args[0]))


def _nullif(c: Compiler, args: list[Value]) -> Value:
    return c._apply(F.nullif, *c._alike(args))


def _cast_to(kind: str):
    return (1, 1, lambda c, args: c._tried(args[0], kind))


def _datediff(a: Column, b: Column) -> Column:
    return F.datediff(a.cast("date"), b.cast("date"))


def _helper(c: Compiler, args: list[Value]) -> Value:
    return c._apply(lambda a, b: F.call_function("link_extract", a, b), c._string(args[0]), c._string(args[1]))


MANY = 1000

#: name: least and most arguments, and what builds the call.
FUNCTIONS: dict[str, tuple[int, int, Callable[[Compiler, list[Value]], Value]]] = {
    **{n: _one("s", f) for n, f in {
        "lower": F.lower, "lcase": F.lower, "upper": F.upper, "ucase": F.upper, "length": F.length, "len": F.length, "char_length": F.length,
        "character_length": F.length, "reverse": F.reverse, "initcap": F.initcap, "md5": lambda s: F.md5(s.cast("binary")), "ascii": F.ascii,
    }.items()},
    **{n: _one("ss", f) for n, f in {
        "contains": F.contains, "startswith": F.startswith, "endswith": F.endswith, "instr": lambda s, t: F.position(t, s),
    }.items()},
    "trim": (1, 2, lambda c, args: c._apply(lambda s, *cut: F.trim(s, *cut), *[c._string(a) for a in args])),
    "ltrim": _one("s", F.ltrim), "rtrim": _one("s", F.rtrim), "replace": _one("sss", F.replace, 2), "translate": (3, 3, _takes(
        "sss", lambda s, a, b: F.call_function("translate", s, a, b))),
    "substring": (2, 3, _substring), "substr": (2, 3, _substring), "left": _one("si", F.left), "right": _one("si", F.right),
    "locate": (2, 3, _locate), "position": (2, 3, _locate),
    "concat": (1, MANY, lambda c, args: c._apply(F.concat, *[c._string(a) for a in args])),
    "split": (2, 2, _regexp(lambda t, p: F.split(t, p))), "rlike": (2, 2, _matched), "regexp": (2, 2, _matched), "regexp_like": (2, 2, _matched),
    "regexp_count": (2, 2, _regexp(F.regexp_count)), "regexp_extract": (2, 3, _regexp_extract),
    "regexp_replace": (3, 3, _regexp_replace),
    "size": _one("a", F.array_size), "cardinality": _one("a", F.array_size), "array_size": _one("a", F.array_size),
    "array": (0, MANY, _array_of), "array_contains": (2, 2, _array_contains), "arrays_overlap": (2, 2, _overlap),
    "array_distinct": _one("a", F.array_distinct), "array_join": (2, 2, _takes("ws", lambda a, s: F.call_function("array_join", a, s))),
    "element_at": (2, 2, _takes("ai", lambda a, i: F.try_element_at(a, F.nullif(i, F.lit(0))))),
    "try_element_at": (2, 2, _takes("ai", lambda a, i: F.try_element_at(a, F.nullif(i, F.lit(0))))), "get": _one("ai", F.get),
    "any_in": (2, 2, _any_in), "any_word": (2, 2, _any_word), "link_extract": (2, 2, _helper),
    "abs": (1, 1, lambda c, args: (lambda v: c._apply(
        lambda x: F.abs(F.nullif(x, F.lit(LEAST_LONG))) if isinstance(v.type, T.LongType) else F.abs(x), v))(c._number(args[0]))),
    "sign": _one("n", lambda x: F.signum(x.cast("double"))), "signum": _one("n", lambda x: F.signum(x.cast("double"))),
    "floor": _one("n", lambda x: F.floor(x.cast("double"))), "ceil": _one("n", lambda x: F.ceil(x.cast("double"))),
    "ceiling": _one("n", lambda x: F.ceil(x.cast("double"))), "round": (1, 1, _round), "sqrt": _one("n", lambda x: F.sqrt(x.cast("double"))),
    **{n: (2, 2, OPERATORS[o]) for n, o in {
        "try_add": "Add", "try_subtract": "Subtract", "try_multiply": "Multiply", "try_divide": "Divide", "try_mod": "Remainder", "mod": "Remainder",
        "div": "IntegralDivide",
    }.items()},
    "coalesce": (1, MANY, _each_alike(F.coalesce)), "ifnull": (2, 2, _each_alike(F.coalesce)), "nvl": (2, 2, _each_alike(F.coalesce)),
    "nullif": (2, 2, _nullif), "greatest": (2, MANY, _each_alike(F.greatest)), "least": (2, MANY, _each_alike(F.least)),
    "if": (3, 3, _cases), "isnull": _one("x", F.isnull), "isnotnull": _one("x", F.isnotnull),
    "between": (3, 3, lambda c, args: c._apply(lambda a, lo, hi: (a >= lo) & (a <= hi), *c._alike(args))),
    **{n: _one("t", f) for n, f in {
        "year": F.year, "month": F.month, "day": F.day, "dayofmonth": F.dayofmonth, "dayofweek": F.dayofweek, "dayofyear": F.dayofyear,
        "hour": F.hour, "minute": F.minute, "to_timestamp": lambda t: t, "to_date": lambda t: t.cast("date"), "unix_timestamp": F.unix_timestamp,
    }.items()},
    "datediff": _one("tt", _datediff), "date_diff": _one("tt", _datediff),
    **{n: _cast_to(n) for n in ("int", "bigint", "double", "string", "boolean", "date", "timestamp")},
}

LAMBDAS = {"exists": F.exists, "any_match": F.exists, "forall": F.forall, "filter": F.filter, "transform": F.transform}
