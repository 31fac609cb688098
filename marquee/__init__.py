"""marquee: a PySpark-native analytics engine for personalised event discovery."""
