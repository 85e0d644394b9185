"""The stateful gate and its replay over tables and streams."""
