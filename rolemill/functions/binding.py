"""Name an intermediate value inside one Column."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once.

    A Column that mentions a regex several times repeats it in the plan, which
    costs time and can outgrow generated code. Binding it as a lambda variable
    of a one-element array avoids both and keeps the row in the JVM.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
