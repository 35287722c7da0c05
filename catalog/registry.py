"""Name -> (Spark query, SQL for the same answer)."""
ENTRIES = {}


def register(name, sql=None):
    def wrap(fn):
        if name in ENTRIES:
            raise KeyError(name)
        ENTRIES[name] = (fn, sql)
        return fn
    return wrap
