"""DataFrame operators for use with ``df.transform``; lazy unless their text says otherwise."""
