"""Jobs of the reference re-expressed as Spark plans; importing registers their queries."""
from .registry import ORACLE, QUERIES  # noqa: F401
from . import scoring  # noqa: F401
from . import prepare  # noqa: F401
from . import senses  # noqa: F401
from . import io  # noqa: F401
from . import sweeps  # noqa: F401
