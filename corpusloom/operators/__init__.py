"""DataFrame -> DataFrame operators over the ``files`` table."""
