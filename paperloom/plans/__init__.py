"""Plan building blocks shared by the operators: order statistics, blocked pair scans, materialisation."""
