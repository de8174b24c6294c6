"""What the operators of this subpackage share."""

from __future__ import annotations

import pyarrow as pa

from lumenframe.runtime import checkpointed, components, dealt_key, hot_join, own_name, shared_folder, shared_root

#: Words are runs of anything but ASCII white space; ``bytes.split()`` cuts
#: UTF-8 exactly there.
WORD = r"[^\x20\x09-\x0D]+"



def tidy(out: pa.Array) -> pa.Array:
    """``out``, after giving back what Arrow holds of the batches before.

    A worker lives through many stages, and an executor's memory is shared by
    its workers and Spark.
    """
    pa.default_memory_pool().release_unused()
    return out


__all__ = ["WORD", "checkpointed", "components", "dealt_key", "hot_join", "own_name", "shared_folder", "shared_root", "tidy"]
