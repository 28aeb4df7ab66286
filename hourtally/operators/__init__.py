"""DataFrame -> DataFrame steps, all lazy unless a function says otherwise."""
