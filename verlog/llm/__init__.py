"""Training-data operators: one module each, plus their queries in ``queries``.

Nothing outside this subpackage (but for the guarded hook of the driver entry
and the pipeline module) imports it.
"""
