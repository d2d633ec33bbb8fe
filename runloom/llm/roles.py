"""Reading roles as typed by different exporters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: other names of roles
ASSISTANT = ("assistant", "agent", "ai")
TOOL = ("tool", "observation", "function")
USER = ("user", "human")

#: White space and characters that show nothing.
INVISIBLE = r"[\s\p{Z}\p{Cf}\x{00AD}\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180E}\x{2800}\x{3164}\x{FE00}-\x{FE0F}\x{FFA0}\p{Cc}]"


def blank(c: Column) -> Column:
    """Whether a text is null, empty or only white space and invisible characters; never null itself."""
    return F.coalesce(F.regexp_replace(c, INVISIBLE + "+", "") == "", F.lit(True))


def speaker(c: Column) -> Column:
    """The role without regard to case, surrounding space and other names; unknown names stay, null stays null."""
    plain = F.lower(F.regexp_replace(c, f"^{INVISIBLE}+|{INVISIBLE}+$", ""))
    return F.when(plain.isin(*ASSISTANT), "assistant").when(plain.isin(*TOOL), "tool").when(plain.isin(*USER), "user").otherwise(plain)
