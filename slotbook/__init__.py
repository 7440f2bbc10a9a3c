"""slotbook: booking-marketplace analytics as Spark jobs.

* ``sources``   raw tables (declared schemas) and the domain ``Catalog``
* ``functions`` validation rules, paging, naming, privacy, deterministic ids
* ``operators`` as-of lookups, keyed updates / appends
* ``plans``     reports, places, access gate, rule-checked writes
* ``streaming`` expiry and daily profit on Structured Streaming
* ``registry``  the registered queries and their oracle SQL
"""

__version__ = "0.1.0"
