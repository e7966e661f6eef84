"""Event-time operators. Each takes a DataFrame that may be batch or streaming, unless it says otherwise."""
